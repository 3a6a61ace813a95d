"""From raw curves to clean ones: bins, signal to noise, local outliers, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..cluster import cut
from ..sources.curves import KEYS

#: The standard deviation of a normal distribution over its median absolute deviation.
SIGMA = 1.4826
#: Windows that are scored at once.
AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Cleaning:
    """Settings of ``clean``."""

    bin_days: float = 4.0
    error_mode: str = "mean"
    binning: bool = True
    signal_mode: str = "amplitude"
    snr_filter: bool = True
    min_snr: float | None = 0.8
    max_noise_signal_ratio: float | None = None
    remove_invalid_snr: bool = False
    half_window: int = 5
    alpha: float = 0.7
    clip: float = 2.5
    exclude_center: bool = True
    threshold: float = 4.0
    min_points_before: int = 3
    min_points_after: int = 20
    max_outlier_fraction: float = 0.5


def binned(curves: DataFrame, days: float = 4.0, error_mode: str = "mean", others: tuple[str, ...] = ()) -> DataFrame:
    """One row per curve and bin of ``days`` from the curve's first time on:
    mean time and flux, error by mode, n, and the bin's ends.

    The error is the mean or the quadrature of positive errors, or ("sem") the
    standard error of the flux, of a single point its own error. A column of
    ``others`` keeps its value where a bin has only one, else it is null.
    """
    first = curves.groupBy(*KEYS).agg(F.min("t").alias("t0"))
    placed = curves.join(first, KEYS).withColumn("bin", F.floor((F.col("t") - F.col("t0")) / days))
    good = F.when(F.col("s") > 0, F.col("s"))
    error = {
        "mean": F.avg(good),
        "quadrature": F.sqrt(F.sum(good * good)) / F.count(good),
        "sem": F.when(F.count("y") > 1, F.stddev_samp("y") / F.sqrt(F.count("y"))).otherwise(F.max(good)),
    }[error_mode]
    same = [F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in others]
    rows = placed.groupBy(*KEYS, "bin").agg(F.avg("t").alias("t"), F.avg("y").alias("y"), error.alias("s"), F.count("*").alias("n"), F.min("t0").alias("t0"), *same)
    start = F.col("t0") + F.col("bin") * days
    return rows.withColumn("bin_start", start).withColumn("bin_end", start + days).drop("t0")


def signal_to_noise(curves: DataFrame, mode: str = "amplitude") -> DataFrame:
    """Per curve: n, signal, noise, snr, noise_signal_ratio and snr_reason.

    The signal is half the spread of the middle 90 %, the population standard
    deviation, or the scaled median absolute deviation; the noise is the median
    positive error. A curve of no signal has an infinite ratio, given as null
    with ``endless_noise``.
    """
    rows = curves
    if mode == "robust_std":
        middle = curves.groupBy(*KEYS).agg(F.median("y").alias("middle"))
        rows = curves.join(middle, KEYS)
    signal = {
        "amplitude": (F.percentile("y", F.lit(0.95)) - F.percentile("y", F.lit(0.05))) / 2,
        "std": F.stddev_pop("y"),
        "robust_std": F.median(F.abs(F.col("y") - F.col("middle"))) * SIGMA if mode == "robust_std" else F.lit(None),
    }[mode]
    found = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count("y").alias("points"), F.count(F.when(F.col("s") > 0, 1)).alias("errors"),
        signal.alias("signal"), F.median(F.when(F.col("s") > 0, F.col("s"))).alias("noise"),
    )
    reason = (
        F.when(F.col("points") < 3, "not_enough_flux_points")
        .when(F.col("errors") == 0, "no_valid_error_values")
        .when(F.col("signal").isNull() | (F.col("signal") <= 0), "invalid_or_zero_signal")
        .otherwise("ok")
    )
    usable, ok = ~F.col("snr_reason").isin("not_enough_flux_points", "no_valid_error_values"), F.col("snr_reason") == "ok"
    return found.withColumn("snr_reason", reason).select(
        *KEYS, "n", F.when(usable, F.col("signal")).alias("signal"), F.when(usable, F.col("noise")).alias("noise"),
        F.when(ok, F.col("signal") / F.col("noise")).alias("snr"), F.when(ok, F.col("noise") / F.col("signal")).alias("noise_signal_ratio"),
        (F.col("snr_reason") == "invalid_or_zero_signal").alias("endless_noise"), "snr_reason",
    )


def snr_verdict(how: Cleaning) -> Column:
    """Why a curve of signal_to_noise goes, or null."""
    verdict = F.lit(None).cast("string")
    if not how.snr_filter:
        return verdict
    if how.max_noise_signal_ratio is not None:
        most = F.lit(float(how.max_noise_signal_ratio))
        verdict = F.when(F.col("noise_signal_ratio") > most, F.format_string("bad_noise_signal_ratio (nsr=%.3f > max_nsr=%.3f)", "noise_signal_ratio", most)).otherwise(verdict)
    if how.min_snr is not None:
        least = F.lit(float(how.min_snr))
        verdict = F.when(F.col("snr") < least, F.format_string("bad_snr_low (snr=%.3f < min_snr=%.3f)", "snr", least)).otherwise(verdict)
    if how.remove_invalid_snr:
        verdict = F.when(F.col("snr").isNull(), F.concat(F.lit("bad_snr_nan_or_invalid ("), "snr_reason", F.lit(")"))).otherwise(verdict)
    return verdict


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_scores(y: np.ndarray, half: int, alpha: float, clip: float, exclude: bool) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Of each value of a curve in order: median and robust scale of the window
    around it, how many values that holds, and its z (NaN without a scale).

    The scale is alpha parts of the scaled median absolute deviation, the rest
    root mean square of the residuals cut at ``clip`` such deviations; it is 0
    where the deviation is.
    """
    n, width = len(y), min(2 * half + 1, len(y))
    held = width - exclude
    center, scale = np.full(n, np.nan), np.full(n, np.nan)
    for start in range(0, n if held else 0, AT_ONCE):
        place = np.arange(start, min(start + AT_ONCE, n))
        at = np.clip(place - half, 0, n - width)[:, None] + np.arange(width)
        near = y[at][at != place[:, None]].reshape(len(place), held) if exclude else y[at]
        middle = np.median(near, axis=1)
        away = np.abs(near - middle[:, None])
        mad = SIGMA * np.median(away, axis=1)
        cut_off = np.sqrt((np.minimum(away, clip * mad[:, None]) ** 2).mean(axis=1))
        center[place], scale[place] = middle, np.where(mad > 0, alpha * mad + (1 - alpha) * cut_off, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(scale > 0, (y - center) / scale, np.nan)
    return center, scale, held, z


def local_scores(curves: DataFrame, half_window: int = 5, alpha: float = 0.7, clip: float = 2.5, exclude_center: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Adds local_median, local_scale, n_near and z of each point against its
    neighbours in time (``window_scores``). Fluxes must not be null.

    The window holds 2 h + 1 points; near an end of the curve it slides inward
    instead of shrinking. A curve's rows are gathered once, in order of time, flux
    and error, and its windows are one kernel's work; ``spread.in_blocks``
    divides curves that no task should hold.
    """
    if half_window < 1:
        raise ValueError("half_window must be at least 1")
    others = [c for c in curves.columns if c not in (*keys, "t", "y", "s")]
    rows = curves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "y", "s", *others))).alias("p"))
    local = StructType([StructField("local_median", DoubleType()), StructField("local_scale", DoubleType()), StructField("n_near", IntegerType()), StructField("z", DoubleType())])
    schema = StructType([*rows.schema.fields, StructField("local", ArrayType(local))])
    kinds = (pa.float64(), pa.float64(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(batch.num_columns - 1)
            sizes = points.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            y = points.flatten().field("y").to_numpy(zero_copy_only=False)
            made = [window_scores(y[i:j], half_window, alpha, clip, exclude_center) for i, j in zip(ends, ends[1:], strict=False)]
            columns = [np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.repeat([m[2] for m in made], sizes), np.concatenate([m[3] for m in made])]
            found = pa.StructArray.from_arrays([pa.array(c, kind, from_pandas=True) for c, kind in zip(columns, kinds, strict=True)], names=local.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=schema.names)

    scored = rows.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("p", "local")).alias("e"))
    return scored.select(*[F.col(c) if c in keys else F.col(f"e.p.{c}").alias(c) for c in curves.columns], "e.local.*")


@dataclass
class Cleaned:
    """What ``clean`` makes: tables that Spark computes when they are used."""

    clean: DataFrame
    report: DataFrame
    removed_rows: DataFrame
    removed_points: DataFrame
    summary: DataFrame
    how: Cleaning = field(default_factory=Cleaning)


def clean(curves: DataFrame, how: Cleaning | None = None, **changes) -> Cleaned:
    """Bins curves, drops those of too little signal or too few points, then
    single outliers, then curves that lost too much.

    The order of the tests decides the reason that is reported: signal to
    noise, points before, then points after, then the share of outliers.
    """
    how = replace(how or Cleaning(), **changes)
    # every output reads the rows and what they were scored
    rows = cut(binned(curves, how.bin_days, how.error_mode) if how.binning else curves)
    metrics = signal_to_noise(rows, how.signal_mode)
    few = F.when(F.col("n") < how.min_points_before, F.lit(f"less_than_{how.min_points_before}_points_before_cleaning"))
    metrics = metrics.withColumn("early_reason", F.coalesce(snr_verdict(how), few))

    tested = rows.join(metrics.select(*KEYS, "early_reason"), KEYS)
    scored = local_scores(tested.where("early_reason is null"), how.half_window, how.alpha, how.clip, how.exclude_center)
    scored = cut(scored.withColumn("is_outlier", F.coalesce(F.abs("z") > how.threshold, F.lit(False))))
    found = scored.groupBy(*KEYS).agg(F.count_if("is_outlier").alias("n_outliers"), F.max(F.abs("z")).alias("max_abs_local_z"))
    report = metrics.join(found, KEYS, "left")
    share = F.col("n_outliers") / F.col("n")
    late = F.when(F.col("n") - F.col("n_outliers") < how.min_points_after, F.lit(f"less_than_{how.min_points_after}_points_after_cleaning")).when(
        share > how.max_outlier_fraction, F.format_string("too_many_outliers (outlier_fraction=%.3f > %.3f)", share, F.lit(float(how.max_outlier_fraction)))
    )
    report = report.withColumn("reason", F.coalesce("early_reason", late))
    kept = F.col("reason").isNull()
    report = report.select(
        *KEYS, F.col("n").alias("n_after_binning"), "signal", "noise", "snr", "noise_signal_ratio", "snr_reason", (~kept).alias("removed_source"),
        F.coalesce("reason", F.lit("kept_after_adaptive_rolling_hybrid_cleaning")).alias("source_reason"),
        F.coalesce("n_outliers", F.lit(0)).cast("long").alias("n_removed_points"),
        F.when(kept, F.col("n") - F.col("n_outliers")).otherwise(0).cast("long").alias("n_final"),
        F.when(F.col("early_reason").isNull(), share).alias("outlier_fraction"), "max_abs_local_z",
    )

    verdicts = report.select(*KEYS, "removed_source", "source_reason")
    judged = scored.join(verdicts, KEYS)
    own = [c for c in rows.columns if c not in KEYS]
    cleaned = judged.where("not removed_source and not is_outlier").select(*KEYS, *own)
    dropped = judged.where("removed_source or is_outlier").select(*KEYS, *own, F.when(F.col("removed_source"), F.col("source_reason")).otherwise("adaptive_rolling_hybrid_outlier").alias("removed_reason"))
    early = tested.where("early_reason is not null").select(*KEYS, *own, F.col("early_reason").alias("removed_reason"))
    points = scored.where("is_outlier").drop("early_reason", "is_outlier")
    return Cleaned(cleaned, report, dropped.unionByName(early), points, summary(curves, report, how), how)


def summary(curves: DataFrame, report: DataFrame, how: Cleaning) -> DataFrame:
    """One row of counts over a whole run, with the settings that led to them."""
    raw = curves.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count("*").alias("input_groups"))
    counts = report.agg(
        F.coalesce(F.sum("n_after_binning"), F.lit(0)).alias("rows_after_binning"),
        F.coalesce(F.sum("n_final"), F.lit(0)).alias("clean_rows"),
        F.count_if(~F.col("removed_source")).alias("clean_groups"),
        F.count_if("removed_source").alias("removed_groups"),
        F.coalesce(F.sum("n_removed_points"), F.lit(0)).alias("outlier_points"),
    )
    both = raw.join(counts).withColumn("removed_rows", F.col("rows_after_binning") - F.col("clean_rows"))
    return both.withColumns({"bin_days": F.lit(how.bin_days if how.binning else None).cast("double"), "half_window": F.lit(how.half_window), "threshold": F.lit(how.threshold)})


def removal_counts(cleaned: Cleaned) -> DataFrame:
    """How many curves have each reason."""
    return cleaned.report.groupBy("source_reason").agg(F.count("*").alias("n_groups"))


def first_sources(curves: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """All rows of ``n`` sources: the first by id, or by a hash that ``seed`` varies."""
    if n < 1:
        raise ValueError("the number of sources must be positive")
    order = [F.col("source")] if seed is None else [F.xxhash64("source", F.lit(seed)), F.col("source")]
    return curves.join(curves.select("source").distinct().orderBy(*order).limit(n), "source")
