"""Light-curve tables: column names, types, and reading.

Inside the library a measurement has the columns ``source``, ``component``,
``t`` (days), ``y`` (flux) and ``s`` (one-sigma error, may be null).  Ids are
strings; a number that is no finite number is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import MISSING, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted column names, the preferred first.
ALIASES: dict[str, tuple[str, ...]] = {
    "source": ("source_id", "SourceID", "sourceID", "sourceId", "sourceId_1"),
    "component": ("lensComponentSourceId", "component_source_id", "componentID", "component_id", "componentId", "comp_id", "comp", "image_id"),
    "t": ("epoch_obs_jd", "time", "jd", "JD", "mjd", "MJD", "time_days", "date"),
    "y": ("flux_obs", "flux", "Flux", "magnitude", "mag"),
    "s": ("flux_obs_error", "flux_error", "err", "error", "sigma"),
    "flag": ("flag_outlier",),
}
PAIR_ALIASES: dict[str, tuple[str, ...]] = {
    "source": ("source_id", "SourceID", "sourceID"),
    "a": ("component_a", "comp_A_reference", "comp_a", "componentA"),
    "b": ("component_b", "comp_B", "comp_b", "componentB"),
}
CANONICAL = {"source": "source_id", "component": "lensComponentSourceId", "t": "epoch_obs_jd", "y": "flux_obs", "s": "flux_obs_error", "flag": "flag_outlier"}
TIME_HINTS = ("jd", "julian", "time", "date", "epoch")
TRUE_WORDS = ("true", "t", "yes", "y", "1")

KEYS = ["source", "component"]
CURVE_FILE = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("lensComponentSourceId", T.StringType()),
        T.StructField("epoch_obs_jd", T.StringType()),
        T.StructField("flux_obs", T.StringType()),
        T.StructField("flux_obs_error", T.StringType()),
        T.StructField("flag_outlier", T.StringType()),
    ]
)


def resolve(columns: Sequence[str], names: Iterable[str]) -> str | None:
    """The first of ``names`` among the columns: as written, else whatever the case."""
    lowered = {c.lower(): c for c in reversed(columns)}
    names = list(names)
    return next((n for n in names if n in columns), None) or next((lowered[n.lower()] for n in names if n.lower() in lowered), None)


def resolved(columns: Sequence[str], aliases: Mapping[str, Iterable[str]], required: Iterable[str]) -> dict[str, str]:
    """The column of each name that has one; all required ones that lack are reported at once."""
    found = {k: c for k, names in aliases.items() if (c := resolve(columns, [k, *names]))}
    missing = [f"{k} (one of {', '.join(aliases[k])})" for k in required if k not in found]
    if missing:
        raise ValueError(f"columns not found: {'; '.join(missing)}")
    return found


def guess_time_column(columns: Sequence[str]) -> str:
    """A known time column, else the first whose name hints at time."""
    found = resolve(columns, ALIASES["t"]) or next((c for c in columns if any(h in c.lower() for h in TIME_HINTS)), None)
    if found is None:
        raise ValueError("no time column found")
    return found


def group_columns(columns: Sequence[str]) -> list[str]:
    """The source and component columns that are there; at least one must be."""
    found = [c for k in KEYS if (c := resolve(columns, ALIASES[k]))]
    if not found:
        raise ValueError("neither a source nor a component column found")
    return found


def number(column: Column | str) -> Column:
    """A finite double, or null for anything else."""
    value = F.col(column) if isinstance(column, str) else column
    value = value.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def flag(column: str) -> Column:
    """Whether a flag says true; null and any other word say false."""
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def canonical(df: DataFrame, *, required: Sequence[str] = ("source", "component", "t", "y"), keep_others: bool = False, without_flagged: bool = False) -> DataFrame:
    """``df`` with the library's columns: renamed, cast, and without rows that
    lack a key, a time or a flux. A missing error column is null throughout."""
    found = resolved(df.columns, ALIASES, required)
    picked = [F.col(f"`{found[k]}`").cast("string").alias(k) for k in KEYS if k in found]
    picked += [number(F.col(f"`{found[k]}`")).alias(k) if k in found else F.lit(None).cast("double").alias(k) for k in ("t", "y", "s")]
    if "flag" in found:
        picked.append(flag(found["flag"]).alias("flag"))
    if keep_others:
        picked += [F.col(f"`{c}`") for c in df.columns if c not in found.values() and c not in found]
    out = df.select(*picked).dropna(subset=[k for k in (*KEYS, "t", "y") if k in found])
    return out.where("not flag") if without_flagged and "flag" in found else out


def with_known_names(df: DataFrame) -> DataFrame:
    """The library's columns under their usual names in files."""
    return df.withColumnsRenamed({k: v for k, v in CANONICAL.items() if k in df.columns})


def valid(df: DataFrame) -> DataFrame:
    """Rows whose time, flux and error are numbers, the error positive."""
    return df.where("t is not null and y is not null and s > 0")


def read_curves(spark: SparkSession, path: str, **how) -> DataFrame:
    """Curves of CSV or Parquet files. All CSV columns are read as text, so ids never become numbers."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    return canonical(raw, **how)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, a, b): the listed pairs, as rows to join with."""
    raw = spark.read.option("header", True).csv(path)
    found = resolved(raw.columns, PAIR_ALIASES, PAIR_ALIASES)
    return raw.select(*[F.col(f"`{found[k]}`").cast("string").alias(k) for k in PAIR_ALIASES]).dropna()


def nested(df: DataFrame) -> DataFrame:
    """One row per curve: its points as an array ordered by time, then flux and error."""
    return df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("t", "y", "s"))).alias("points"))


def flattened(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.inline("points"))


def profile(text: str, name: str) -> dict:
    """The settings called ``name`` of a JSON object of profiles, without notes."""
    profiles = json.loads(text)
    if name not in profiles:
        raise KeyError(f"unknown profile {name!r}; known are {', '.join(sorted(profiles))}")
    return {k: v for k, v in profiles[name].items() if k != "_description"}


def setting(config: object, name: str, default: object) -> object:
    """A setting of a mapping or of an object's attribute, else the default."""
    return config.get(name, default) if isinstance(config, Mapping) else getattr(config, name, default)


def settings(kind: type, config: object, **names: str):
    """A dataclass of settings from a mapping or an object: fields that it has,
    under their own name or the one that ``names`` gives; all others by default."""
    found = {}
    for f in fields(kind):
        value = setting(config, names.get(f.name, f.name), MISSING)
        if value is not MISSING:
            found[f.name] = value
    return kind(**found)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of a folder, seen as curves: a supplier is a source, a
    return flag its component, the price a flux, the discount sets its error."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)") / F.lit(86400.0)
    return items.select(
        F.col("l_suppkey").cast("string").alias("source"),
        F.col("l_returnflag").alias("component"),
        (days + 2440587.5).alias("t"),
        (F.col("l_extendedprice") / 1000.0).alias("y"),
        ((F.col("l_discount") + 0.01) * 8 * F.col("l_extendedprice") / 1000.0).alias("s"),
    )
