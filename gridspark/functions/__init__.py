"""Column functions: Column in, Column out, no UDFs."""
