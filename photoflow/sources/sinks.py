"""Writing results: one partitioned write per table, and resuming by what is there."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .curves import with_known_names


def write_tables(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Each table in a folder of its name; CSV files get headers and the usual column names."""
    for name, table in tables.items():
        writer = (with_known_names(table) if form == "csv" else table).write.mode(mode)
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{folder}/{name}")


def write_cleaned(cleaned, folder: str, form: str = "csv") -> None:
    """All tables of a cleaning run, with its summary and counts by reason."""
    reasons = cleaned.report.groupBy("source_reason").agg(F.count("*").alias("n_groups"))
    tables = {"clean": cleaned.clean, "report": cleaned.report, "removed_rows": cleaned.removed_rows, "removed_points": cleaned.removed_points}
    write_tables(tables | {"summary": cleaned.summary, "removed_by_reason": reasons}, folder, form)


#: Directories that results are dealt to by a hash of their source.
BUCKETS = 64


def write_by_source(results: DataFrame, folder: str) -> None:
    """Appends results, dealt to a fixed number of directories by their source,
    so that a later run can see what is done."""
    bucket = F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")
    results.withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def unfinished(spark: SparkSession, pairs: DataFrame, folder: str, keys: tuple[str, ...] = ("source", "a", "b")) -> DataFrame:
    """Pairs that the folder of ``write_by_source`` has no result of: all of
    them if there is no such folder yet. Sources are read as text."""
    try:
        finished = spark.read.schema(results_schema(pairs, keys)).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return pairs
    return pairs.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def write_predictions(predictions: DataFrame, path: str, keys: tuple[str, ...] = ("source", "component"), failures: DataFrame | None = None) -> None:
    """Predictions as CSV in the order of their keys: files in the order of their
    names, each sorted, one per range of keys. Failed ones are in a table beside
    it with their reason, and in the first with a null score."""
    predictions.orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)
    if failures is not None:
        failures.write.mode("overwrite").option("header", True).csv(f"{path}_errors")


def write_delays(folder: str, estimates: DataFrame | None, profile: DataFrame | None = None, summary: DataFrame | None = None, samples: DataFrame | None = None, failed_systems: DataFrame | None = None, form: str = "csv", **others: DataFrame) -> None:
    """The tables of a delay run that there are: arrays become text in CSV files."""
    tables = {"estimates": estimates, "profile": profile, "summary": summary, "samples": samples, "failed_systems": failed_systems, **others}
    for name, table in tables.items():
        if table is not None:
            flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct")) and form == "csv" else F.col(c) for c, kind in table.dtypes]
            write_tables({name: table.select(*flat)}, folder, form)


def results_schema(pairs: DataFrame, keys: tuple[str, ...]):
    return pairs.select(*keys).schema


def without_result(pairs: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("source", "a", "b")) -> DataFrame:
    """Asked pairs that got no result, with a reason: the table of failures."""
    return pairs.join(results.select(*keys).distinct(), list(keys), "left_anti").withColumn("reason", F.lit("no delay with enough overlap, or too few points"))
