"""Pairs of components of a source, and what two curves have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.curves import KEYS

PAIR = ["source", "a", "b"]
#: Days onto which the span of a pair is stretched.
SPAN_DAYS = 2000.0
LEAST_POINTS = 5


def component_pairs(curves: DataFrame, least_points: int = 1) -> DataFrame:
    """(source, a, b): all pairs of a source's components, a before b by id."""
    held = curves.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= least_points)
    a, b = held.select("source", F.col("component").alias("a")), held.select("source", F.col("component").alias("b"))
    return a.join(b, "source").where("a < b")


def first_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """The first pairs in the order of their ids."""
    return pairs.orderBy(*PAIR).limit(most)


def component_groups(curves: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(source, members): the components of each source that has so many, in the order of their ids."""
    found = curves.groupBy("source").agg(F.array_sort(F.collect_set("component")).alias("members"))
    return found.where(F.size("members").between(least, most))


def looked_up(curves: DataFrame, asked: DataFrame, least_points: int = 2) -> DataFrame:
    """Points of the asked systems (source, members), with the place of their
    component; systems of which a component has too few points have none."""
    wanted = asked.select("source", "members", F.posexplode("members").alias("place", "component"))
    rows = wanted.join(curves.where("t is not null and y is not null and s > 0"), KEYS)
    held = rows.groupBy("source", "members", "place").agg(F.count("*").alias("n")).where(F.col("n") >= least_points)
    whole = held.groupBy("source", "members").agg(F.count("*").alias("k")).where(F.col("k") == F.size("members")).drop("k")
    return rows.join(whole, ["source", "members"], "left_semi")


def robust_parts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: middle (the median), mad (the median absolute deviation), iqr (the quartile range) and std."""
    mid = values.groupBy(*keys).agg(F.median(value).alias("middle"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"), F.stddev_pop(value).alias("std"))
    mad = values.join(mid, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("middle"))).alias("mad"))
    return mid.join(mad, keys)


def robust_scale_of(least: float = 1e-6) -> Column:
    """The scaled median absolute deviation, else the scaled quartile range, else
    the standard deviation, else 1, of the columns of ``robust_parts``."""
    mad, iqr = F.col("mad") * 1.4826, F.col("iqr") / 1.349
    return F.when(mad >= least, mad).when(iqr >= least, iqr).when(F.col("std") >= least, F.col("std")).otherwise(1.0)


def robust_scales(values: DataFrame, keys: list[str], value: str, least: float = 1e-6) -> DataFrame:
    """Per key: the median (middle) and the robust scale (``robust_scale_of``)."""
    return robust_parts(values, keys, value).select(*keys, "middle", robust_scale_of(least).alias("scale"))


def guarded_corr(a: str, b: str, least: int = 3) -> Column:
    """The aggregate: Pearson's correlation, 0 with too few pairs of values or without spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    flat = (F.count(x) < least) | (F.stddev_pop(x) < 1e-8) | (F.stddev_pop(y) < 1e-8)
    return F.when(flat, 0.0).otherwise(F.coalesce(F.corr(a, b), F.lit(0.0)))


def guarded_moment(value: str, which: Column) -> Column:
    """The aggregate: a standardised moment, 0 for fewer than 4 values or no spread."""
    return F.when((F.count(value) < 4) | (F.stddev_pop(value) < 1e-8), 0.0).otherwise(which)


def top_means(values: DataFrame, keys: list[str], value: str, sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Per key: the mean of its largest values, of as many as asked or all."""
    ordered = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, max(sizes))
    rows = values.groupBy(*keys).agg(ordered.alias("v"))
    means = [(F.aggregate(F.slice("v", 1, k), F.lit(0.0), lambda a, x: a + x) / F.least(F.size("v"), F.lit(k))).alias(f"top{k}_mean") for k in sizes]
    return rows.select(*keys, *means)


def common_features(columns: list[str], first: str = "a_", second: str = "b_") -> list[str]:
    """What both sides of a pair have, by their columns' prefixes."""
    a, b = ({c.removeprefix(p) for c in columns if c.startswith(p)} for p in (first, second))
    return sorted(a & b)


def at_times(curves: DataFrame, times: DataFrame) -> DataFrame:
    """Flux of each curve on the line between its points at asked times (the
    curve's keys and t); null outside the curve. One sort, no join by range."""
    points = curves.select(*KEYS, F.lit("a").alias("side"), "t", "y", "s").unionByName(times.select(*KEYS, F.lit("b").alias("side"), "t", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("s")))
    flux, variance = interpolated("a0", "a1")
    return bracketed(points, KEYS).where("side = 'b'").select(*KEYS, "t", flux.alias("y"), variance.alias("variance"))


def with_sides(curves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair's points: the pair's columns, side ("a" or "b"), t, y, s."""
    sides = pairs.select(*PAIR, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("component")), F.struct(F.lit("b").alias("side"), F.col("b").alias("component")))).alias("p"))
    return sides.select(*PAIR, "p.side", "p.component").join(curves.select(*KEYS, "t", "y", "s"), KEYS).drop("component")


def stretched(sides: DataFrame, days: float = SPAN_DAYS) -> DataFrame:
    """Times of each pair moved and stretched, so that its joint span is 0 to ``days``."""
    span = sides.groupBy(*PAIR).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    scale = F.lit(days) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1.0))
    return sides.join(span, PAIR).withColumn("t", (F.col("t") - F.col("t0")) * scale).drop("t0", "t1")


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds gap: days since the point before, null at a curve's first."""
    return df.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t", "y", "s")))


def population_moment(value: str, power: int) -> Column:
    return F.avg(F.pow(value, F.lit(float(power))))


def curve_features(df: DataFrame, keys: list[str], per_day: bool = False) -> DataFrame:
    """Statistics of each curve that need no fit: span, gaps, flux quantiles,
    moments, lag correlation (of 4 points or more), slopes and errors, and what a
    line leaves (of fewer than 4 points: the spread). Single points have 0 spreads.
    ``per_day`` adds trend_per_day, the line's slope in days, which models of pairs do not know."""
    order = Window.partitionBy(*keys).orderBy("t", "y", "s")
    rows = df.withColumns({"gap": F.col("t") - F.lag("t").over(order), "y0": F.lag("y").over(order)})
    slope = F.when(F.col("gap") > 1e-5, (F.col("y") - F.col("y0")) / F.sqrt(F.col("gap") + 1))
    trend = [F.regr_slope("y", "t").alias("trend_per_day")] if per_day else []
    basic = rows.withColumn("dy", slope).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.avg("gap").alias("gap_mean"), F.median("gap").alias("gap_median"), F.stddev_pop("gap").alias("gap_std"), F.max("gap").alias("gap_max"),
        (F.percentile("gap", F.lit(0.75)) - F.percentile("gap", F.lit(0.25))).alias("gap_iqr"),
        F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"), F.median("y").alias("y_median"),
        (F.percentile("y", F.lit(0.75)) - F.percentile("y", F.lit(0.25))).alias("y_iqr"),
        (F.percentile("y", F.lit(0.95)) - F.percentile("y", F.lit(0.05))).alias("y_amp_q90"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), guarded_moment("y", F.skewness("y")).alias("y_skew"), guarded_moment("y", F.kurtosis("y")).alias("y_kurt"), *trend,
        F.when((F.count("*") >= 4) & (F.stddev_pop("t") >= 1e-8), F.sqrt(F.regr_syy("y", "t") * (1 - F.regr_r2("y", "t")) / F.count("*"))).otherwise(F.stddev_pop("y")).alias("resid1_std"),
        F.when(F.count("*") >= 4, guarded_corr("y0", "y")).alias("acf1"), F.when(F.count("dy") >= 2, F.stddev_pop("dy")).alias("dy_std"), F.median("s").alias("err_median"), F.avg("s").alias("err_mean"),
    )
    away = df.join(basic.select(*keys, "y_median"), keys).groupBy(*keys).agg((F.median(F.abs(F.col("y") - F.col("y_median"))) * 1.4826).alias("y_mad"))
    names = [c for c in (*basic.columns, "y_mad") if c not in keys]
    joined = basic.join(away, keys)
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def contrasts(features: DataFrame, names: list[str]) -> DataFrame:
    """For features of both sides of a pair: how far, and which way, they differ, and the log of their ratio."""
    a = features.where("side = 'a'").select(*PAIR, *[F.col(c).cast("double").alias(f"a_{c}") for c in names])
    b = features.where("side = 'b'").select(*PAIR, *[F.col(c).cast("double").alias(f"b_{c}") for c in names])
    both, out = a.join(b, PAIR), []
    for c in names:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        out += [F.abs(x - y).alias(f"diff_abs_{c}"), (y - x).alias(f"diff_signed_{c}"), F.ln((F.abs(y) + 1e-3) / (F.abs(x) + 1e-3)).alias(f"ratio_log_{c}")]
    return both.select("*", *out)


def bracketed(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each point the nearest point of either side at or before its time
    (a0, b0) and at or after it (a1, b1), as structs (t, y, s).

    Two sorts of one shuffle, each row read once; no join of points by range.
    Points of a side must have different times.
    """
    point = F.struct("t", "y", "s")
    up = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = {side: F.when(F.col("side") == side, point) for side in "ab"}
    seen = points.select("*", *[F.last(both[x], ignorenulls=True).over(up).alias(f"{x}0") for x in "ab"])
    return seen.select("*", *[F.last(both[x], ignorenulls=True).over(down).alias(f"{x}1") for x in "ab"])


def interpolated(before: str, after: str) -> tuple[Column, Column]:
    """Flux and variance on the line between two points; null outside a curve."""
    x0, x1 = F.col(before), F.col(after)
    share = F.when(x1["t"] > x0["t"], (F.col("t") - x0["t"]) / (x1["t"] - x0["t"])).when(x1["t"] == x0["t"], 0.0)
    flux = x0["y"] * (1 - share) + x1["y"] * share
    return flux, F.pow((1 - share) * x0["s"], F.lit(2.0)) + F.pow(share * x1["s"], F.lit(2.0))


def nearest_times(sides: DataFrame) -> DataFrame:
    """Per pair: how far each point of side a is from the nearest of side b (median, 90 %, shares within 2 and 10 days)."""
    points = sides.groupBy(*PAIR, "side", "t").agg(F.count("*").alias("copies")).withColumns({"y": F.lit(0.0), "s": F.lit(0.0)})
    near = bracketed(points, PAIR).where("side = 'a'")
    days = F.least(F.col("t") - F.col("b0.t"), F.col("b1.t") - F.col("t"))
    rows = near.select(*PAIR, days.alias("days"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.groupBy(*PAIR).agg(
        F.median("days").alias("nn_median"), F.percentile("days", F.lit(0.9)).alias("nn_p90"),
        F.avg((F.col("days") <= 2.0).cast("int")).alias("nn_close_2d"), F.avg((F.col("days") <= 10.0).cast("int")).alias("nn_close_10d"),
    )


def merged_epochs(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of equal time as one: weights are inverse variances."""
    weight = 1 / (F.col("s") * F.col("s"))
    return points.groupBy(*keys, "t").agg((F.sum(F.col("y") * weight) / F.sum(weight)).alias("y"), F.sqrt(1 / F.sum(weight)).alias("s"))


def weighted_mean(value: Column, variance: Column) -> Column:
    """The aggregate with inverse variances as weights."""
    return F.sum(value / variance) / F.sum(1 / variance)


def profile_summary(profile: DataFrame, keys: list[str], delay: str, value: str) -> DataFrame:
    """Features of a curve over delays: its top and where, its value nearest to no delay, spread, and how far the top stands out."""
    top = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 6)
    rows = profile.groupBy(*keys).agg(
        F.max(value).alias("top"), F.max_by(delay, F.struct(F.col(value), -F.col(delay))).alias("top_delay"),
        F.min_by(value, F.struct(F.abs(delay), F.col(delay))).alias("at_zero"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.percentile(value, F.lit(0.95)).alias("p95"), F.avg((F.col(value) > 0.3).cast("int")).alias("over_03"), F.avg((F.col(value) > 0.5).cast("int")).alias("over_05"), top.alias("tops"),
    )
    rest = F.slice("tops", 2, 5)
    return rows.select(*keys, "top", "top_delay", F.abs("top_delay").alias("top_delay_abs"), "at_zero", "mean", "std", "p95", "over_03", "over_05", (F.get("tops", F.lit(0)) - F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)).alias("stands_out"))


def sample_summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quantiles of repeated estimates; nulls do not count, and one sample has no spread."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.025, 0.16, 0.5, 0.84, 0.975)]))
    rows = samples.groupBy(*keys).agg(F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), q.alias("q")).where("n_valid > 0")
    at = [F.get("q", F.lit(i)) for i in range(5)]
    return rows.select(*keys, "n_valid", "mean", "std", at[2].alias("median"), at[1].alias("q16"), at[3].alias("q84"), (at[2] - at[1]).alias("err_minus"), (at[3] - at[2]).alias("err_plus"), at[0].alias("q025"), at[4].alias("q975"))
