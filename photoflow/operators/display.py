"""Tables ready to be drawn: flux modes, smoothing, times, thinning, counts."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.curves import KEYS, number
from .arrays import mapped
from .spread import numbered

MODES = ("raw", "centered", "normalized", "minmax", "first=0", "first=1")
#: Other names of the modes.
SYNONYMS = {"none": "raw", "normalize": "normalized", "normalization": "normalized", "zscore": "normalized"}


def in_mode(curves: DataFrame, mode: str) -> DataFrame:
    """Flux in a mode, and errors by the divisor that the mode has for them."""
    mode = SYNONYMS.get(mode.lower(), mode.lower())
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    whole = Window.partitionBy(*KEYS)
    ordered = whole.orderBy("t", "y", "s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y, one = F.col("y"), F.lit(1.0)
    mean, std, low, high, first = F.avg(y).over(whole), F.stddev_pop(y).over(whole), F.min(y).over(whole), F.max(y).over(whole), F.first(y).over(ordered)
    value, divisor = {
        "raw": (y, one),
        "centered": (y - mean, one),
        "normalized": (F.when(std > 0, (y - mean) / std).otherwise(y), F.when(std > 0, std).otherwise(one)),
        "minmax": (F.when(high > low, (y - low) / (high - low)).otherwise(y), F.when(high > low, high - low).otherwise(one)),
        "first=0": (y - first, one),
        "first=1": (F.when(first != 0, y / first).otherwise(y), F.when(first != 0, F.abs(first)).otherwise(one)),
    }[mode]
    return curves.select(*KEYS, "t", value.alias("y"), (F.col("s") / divisor).alias("s"))


def smoothed(curves: DataFrame, window: int, keys: list[str] = KEYS) -> DataFrame:
    """Adds the centred moving mean over ``window`` points, fewer at the ends."""
    frame = Window.partitionBy(*keys).orderBy("t", "y", "s").rowsBetween(-(window // 2), (window - 1) // 2)
    return curves.withColumn("smooth", F.avg("y").over(frame) if window > 1 else F.col("y"))


def shown(curves: DataFrame, sources: list[str] | None = None, components: list[str] | None = None) -> DataFrame:
    """Curves of the named sources and components; ids are compared as text, and
    one or two components can be shown beside each other."""
    if components is not None and not 1 <= len(components) <= 2:
        raise ValueError("one or two components can be shown")
    for column, wanted in (("source", sources), ("component", components)):
        if wanted is not None:
            curves = curves.where(F.col(column).cast("string").isin(*map(str, wanted)))
    return curves


def group_titles(curves: DataFrame) -> DataFrame:
    """A title of each curve: its keys and their values."""
    title = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in KEYS])
    return curves.select(*KEYS).distinct().withColumn("title", title)


def ranked_groups(curves: DataFrame) -> DataFrame:
    """Curves in the order of their first point: rank, from 1."""
    first = curves.groupBy(*KEYS).agg(F.min("t").alias("first"))
    return numbered(first, [F.col(c) for c in ("first", *KEYS)], "rank").withColumn("rank", F.col("rank").cast("int"))


def gaussian_process(curves: DataFrame, length: float = 180.0, points: int = 400, error_share: float = 0.05) -> DataFrame:
    """A smooth line with one sigma of each curve at ``points`` even times: the
    posterior of a Gaussian process whose kernel is a constant (the flux's
    variance) times a squared exponential of fixed length; the noise is a
    share of the errors, squared. A curve is one row's work, of the cube of its points."""
    row = F.array_sort(F.collect_list(F.struct("t", "y", "s")))
    rows = curves.groupBy(*KEYS).agg(row.alias("p")).select(*KEYS, *[F.col("p")[c].alias(f"p{c}") for c in "tys"])

    def kernel(t, y, s) -> dict:
        middle, size = y.mean(), max(float(y.var()), 1e-12)
        noise = np.maximum((error_share * np.nan_to_num(s)) ** 2, 1e-6 * size)
        at = np.linspace(t[0], t[-1], points)

        def like(a, b):
            return size * np.exp(-0.5 * ((a[:, None] - b) / length) ** 2)

        lower = np.linalg.cholesky(like(t, t) + np.diag(noise))
        across = np.linalg.solve(lower, like(t, at))
        line = across.T @ np.linalg.solve(lower, y - middle)
        return {"t": at, "line": middle + line, "sigma": np.sqrt(np.maximum(size - (across**2).sum(axis=0), 0.0))}

    return mapped(rows, KEYS, kernel, "t double, line double, sigma double")


def julian_days(value: Column) -> Column:
    """Julian days of Julian or modified Julian days."""
    return F.when(value.between(30000, 100000), value + 2400000.5).otherwise(value)


def timestamp_of(days: Column) -> Column:
    return F.timestamp_micros(F.round((julian_days(days) - 2440587.5) * 86400e6).cast("long"))


def thinned(curves: DataFrame, most: int) -> DataFrame:
    """At most ``most`` points of each curve, evenly from the first to the last."""
    order = Window.partitionBy(*KEYS).orderBy("t", "y", "s")
    rows = curves.withColumns({"i": F.row_number().over(order) - 1, "size": F.count("*").over(Window.partitionBy(*KEYS))})
    step = (F.col("size") - 1) / max(most - 1, 1)
    k = F.ceil(F.col("i") / step)
    picked = (F.col("size") <= most) | (F.floor(k * step) == F.col("i"))
    return rows.where(picked).drop("i", "size")


def shifted(curves: DataFrame, delays: dict[str, float]) -> DataFrame:
    """Curves with each component's time moved earlier by its delay."""
    moved = F.col("t")
    for component, delay in delays.items():
        moved = F.when(F.col("component") == component, F.col("t") - delay).otherwise(moved)
    return curves.withColumn("t", moved)


def histogram(values: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin; values outside are in bins 0 and ``bins`` + 1."""
    return values.groupBy(*keys, F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that hold at least one number, also as text; one pass over the table."""
    counts = df.agg(*[F.count(number(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for c, n in zip(df.columns, counts, strict=True) if n]


def even_steps(low: Column, high: Column, n: int, by_factors: bool = False) -> Column:
    """An array of n numbers from low to high, at equal distances or by equal factors."""
    share = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(max(n - 1, 1))))
    if by_factors:
        return F.transform(share, lambda f: low * F.pow(high / low, f))
    return F.transform(share, lambda f: low + (high - low) * f)


def by_component(values: Mapping[str, float] | None, otherwise: float) -> Column:
    """The value that a mapping has for a row's component."""
    pairs = [F.lit(x) for k, v in (values or {}).items() for x in (str(k), float(v))]
    return F.coalesce(F.create_map(*pairs)[F.col("component")], F.lit(float(otherwise))) if pairs else F.lit(float(otherwise))


def component_table(
    curves: DataFrame, components: list[str], mode: str = "raw", *, sources: list[str] | None = None, delays: Mapping[str, float] | None = None, delay: float = 0.0,
    scales: Mapping[str, float] | None = None, offsets: Mapping[str, float] | None = None, window: int = 0, most: int | None = None,
) -> DataFrame:
    """One or two components ready to be drawn over each other: t moved by the
    component's delay, y in a mode and then by its scale and offset, s by what
    the mode and the scale do to errors, at (the time as a timestamp), smooth (a
    moving mean over ``window`` points, null without one) and label.

    Curves are thinned to ``most`` points before the mode looks at them.
    Components without a delay of their own move by ``delay``.
    """
    rows = shown(curves, sources, components)
    rows = in_mode(thinned(rows, most) if most else rows, mode)
    scale, moved = by_component(scales, 1.0), by_component(delays, delay)
    rows = rows.select(*KEYS, (F.col("t") + moved).alias("t"), (F.col("y") * scale + by_component(offsets, 0.0)).alias("y"), F.abs(F.col("s") * scale).alias("s"), moved.alias("moved"))
    rows = smoothed(rows, window) if window else rows.withColumn("smooth", F.lit(None).cast("double"))
    label = F.concat(F.lit("component "), F.col("component"), F.when(F.col("moved") != 0, F.concat(F.lit(" | delay="), F.format_string("%s", F.round("moved", 6)), F.lit(" d"))).otherwise(""))
    return rows.select(*KEYS, "t", timestamp_of(F.col("t")).alias("at"), "y", "s", "smooth", label.alias("label"))
