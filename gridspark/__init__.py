"""gridspark: gridded environmental exposure on Spark DataFrames."""
