"""Samplings of curves: which rows stay, calendar, sky, signatures and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

J2000 = 2451545.0


def fraction(*values: Column) -> Column:
    """A number from 0 to 1 from the MD5 of values joined by slashes."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[v.cast("string") for v in values]).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def kept_by_chance(rows: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """Rows that survive a dropout of ``share``; which ones is a hash of the seed and the keys."""
    return rows.where(fraction(F.lit(seed), *[F.col(k) for k in keys]) >= share)


def within_days(curves: DataFrame, first: float, last: float) -> DataFrame:
    return curves.where(F.col("t").between(first, last))


def calendar(seconds: Column) -> list[Column]:
    """Julian day, modified Julian day and Julian year of seconds since 1970 (UTC)."""
    jd = seconds / F.lit(86400.0) + 2440587.5
    return [jd.alias("jd"), (jd - 2400000.5).alias("mjd"), (2000 + (jd - J2000) / 365.25).alias("jyear")]


def time_unit(value: Column) -> list[Column]:
    """Aggregates that tell the unit of times: Julian days (j), modified ones (m) and
    Julian years (y) are those whose half of the values lies where such times do."""
    n = F.count(value)
    return [(F.count(F.when(test, value)) * 2 > n).alias(name) for name, test in (("j", value > 2e6), ("m", value.between(4e4, 2e6)), ("y", value.between(1900, 2200)))]


def julian_from_any(rows: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """``rows`` with the column as Julian days: Julian days, modified ones or
    Julian years are told apart by where most values lie, from counts alone; else
    it stays, or is an error if ``strict``."""
    value = F.col(column)
    unit = rows.agg(*time_unit(value)).first()
    if strict and not (unit["j"] or unit["m"] or unit["y"]):
        raise ValueError(f"the unit of the times in {column} is unknown")
    jd = value if unit["j"] else value + 2400000.5 if unit["m"] else (value - 2000) * 365.25 + J2000 if unit["y"] else value
    return rows.withColumn(column, jd)


def decoded(rows: DataFrame) -> DataFrame:
    """Binary columns as UTF-8 text."""
    return rows.select(*[F.decode(F.col(f"`{c}`"), "UTF-8").alias(c) if kind == "binary" else F.col(f"`{c}`") for c, kind in rows.dtypes])


def signatures(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: the first 16 hex digits of the SHA-1 of its values in order,
    joined by commas; equal samplings have equal signatures."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), ",")
    return rows.groupBy(*keys).agg(F.substring(F.sha1(joined.cast("binary")), 1, 16).alias("signature"))


def distinct_samplings(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The least key of each sampling."""
    found = signatures(rows, keys, value)
    return found.groupBy("signature").agg(F.min(F.struct(*keys)).alias("k"), F.count("*").alias("copies")).select("k.*", "signature", "copies")


def sky_position(u: Column, v: Column) -> tuple[Column, Column]:
    """Right ascension and declination in degrees, even over the sphere."""
    return u * 360.0, F.degrees(F.asin(v * 2 - 1))


def moved_on_sky(ra: Column, dec: Column, arcsec: Column, angle: Column) -> tuple[Column, Column]:
    """A position moved by a small distance in the direction of an angle (degrees east of north)."""
    degrees = arcsec / 3600.0
    east, north = degrees * F.sin(F.radians(angle)), degrees * F.cos(F.radians(angle))
    return F.pmod(ra + east / F.greatest(F.abs(F.cos(F.radians(dec))), F.lit(1e-6)), F.lit(360.0)), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), dec + north))


def noise_level(curves: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per curve: a share of the median size of its flux, else of its deviation, else of one."""
    found = curves.groupBy(*keys).agg(F.median(F.abs("y")).alias("size"), F.stddev_pop("y").alias("std"))
    return found.select(*keys, (F.when(F.col("size") > 0, F.col("size")).when(F.col("std") > 0, F.col("std")).otherwise(1.0) * share).alias("noise"))
