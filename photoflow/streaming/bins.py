"""Bins of a stream of measurements, for curves that are still growing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.display import timestamp_of
from ..sources.curves import KEYS


def binned_stream(curves: DataFrame, days: int = 4, late_days: int = 30) -> DataFrame:
    """Mean time, flux and error of each curve in windows of whole days.

    Windows start at fixed dates, as a stream does not know a curve's first
    time. A window is final once measurements ``late_days`` later have come;
    what comes after that is dropped. Works on a table as on a stream.
    """
    timed = curves.withColumn("at", timestamp_of(F.col("t"))).withWatermark("at", f"{late_days} days")
    rows = timed.groupBy(*KEYS, F.window("at", f"{days} days").alias("w")).agg(
        F.avg("t").alias("t"), F.avg("y").alias("y"), F.avg(F.when(F.col("s") > 0, F.col("s"))).alias("s"), F.count("*").alias("n")
    )
    return rows.select(*KEYS, F.col("w.start").alias("bin_start"), "t", "y", "s", "n")
