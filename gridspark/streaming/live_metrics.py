"""Station error statistics per 12Z-to-12Z day on a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_metrics(
    observations: DataFrame, predictions: DataFrame, obs: str, pred: str,
    keys: tuple[str, ...] = ("key", "hour_utc"), lateness: str = "6 hours",
) -> DataFrame:
    """prism_day, n, bias, mae, rmse of prediction minus observation per day window.

    `observations` is a stream (or a batch) with time_utc and the keys; `predictions` a static
    table on the same keys. Rows later than `lateness` behind the newest are dropped by the
    watermark. State is one row per open window.
    """
    # Wall-clock UTC to an instant and back, whatever the session's zone.
    zone = F.current_timezone()
    stamped = observations.withColumn("time_utc", F.from_utc_timestamp(F.col("time_utc").cast("timestamp"), zone))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("time_utc", lateness)
    error = F.col(pred) - F.col(obs)
    windows = (
        stamped.join(predictions, list(keys))
        .groupBy(F.window("time_utc", "1 day", "1 day", "12 hours"))
        .agg(F.count(error).alias("n"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"),
             F.sqrt(F.avg(error * error)).alias("rmse"))
    )
    return windows.select(F.to_date(F.to_utc_timestamp("window.end", zone)).alias("prism_day"), "n", "bias", "mae", "rmse")
