"""Visit times from VOTable files or tables: fields by their names, times as Julian days."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import calendar, julian_from_any

#: Types of fields that are numbers: fixed values of the format.
NUMBERS = ("short", "int", "long", "float", "double", "unsignedByte")
#: Names, without case and separators: fixed values.
STARTS, STOPS = ("start", "starttime", "startmjd"), ("stop", "stoptime", "stopmjd")
DATE_HINTS = ("date", "utc", "eventdate", "observationtimeatgaia")
TIME_HINTS = ("mjd", "jd", "time", "epoch")


def read_votable(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a VOTable's TABLEDATA, with the names and types of its fields.

    Fields are a small table of their own; rows are elements that Spark's XML
    source reads apart from each other, so that a large file is many tasks' work.
    Empty cells are null; a field without a name is called by its ID or number.
    """
    def scan(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)

    fields = scan("FIELD", "_name string, _ID string, _datatype string, _arraysize string").coalesce(1).collect()
    if not fields:
        raise ValueError(f"no FIELD found in {path}")
    rows = scan("TR", "TD array<string>")
    taken: list[Column] = []
    for i, f in enumerate(fields):
        cell = F.nullif(F.trim(F.get("TD", F.lit(i))), F.lit(""))
        scalar = f["_datatype"] in NUMBERS and not f["_arraysize"]
        taken.append((cell.try_cast("double") if scalar else cell).alias(f["_name"] or f["_ID"] or f"field_{i}"))
    return rows.where("TD is not null").select(*taken)


def plain_name(column: str) -> str:
    return re.sub(r"[ _\-\[\]]", "", column.lower())


def visit_times(rows: DataFrame) -> DataFrame:
    """t, distinct Julian days in order, of the first of these that gives some:
    the middle of a start and a stop column; a text column of dates; a numeric
    column of times. Julian days, modified ones and years are told apart by where
    most values lie; other numbers are an error."""
    names, kinds = {c: plain_name(c) for c in rows.columns}, dict(rows.dtypes)

    def value(c: str) -> Column:
        number = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(number), number)

    def finished(times: DataFrame, strict: bool = True) -> DataFrame:
        return julian_from_any(times.where("t is not null"), "t", strict=strict).distinct().orderBy("t")

    start = next((c for c, n in names.items() if "tstart" in n or n in STARTS), None)
    stop = next((c for c, n in names.items() if "tstop" in n or n in STOPS), None)
    if start and stop:
        return finished(rows.select(((value(start) + value(stop)) / 2).alias("t")))
    for c, n in names.items():
        if kinds[c] == "string" and any(h in n for h in DATE_HINTS):
            text = F.trim(F.regexp_replace(F.col(f"`{c}`"), r"\((TCB|UTC)\)", ""))
            seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', at)") / F.lit(1e6)
            times = rows.select(F.try_to_timestamp(text).cast("timestamp_ntz").alias("at")).where("at is not null").select(calendar(seconds)[0].alias("t"))
            if not times.isEmpty():
                return times.distinct().orderBy("t")
    for c, n in names.items():
        if kinds[c] != "string" and any(h in n for h in TIME_HINTS):
            times = rows.select(value(c).alias("t")).where("t is not null")
            try:
                found = finished(times)
            except ValueError:
                continue
            if not found.isEmpty():
                return found
    raise ValueError(f"no column of times among {rows.columns}")
