"""Single curves prepared for classifiers, and scores of several models joined."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.curves import KEYS
from .arrays import mapped
from .cleaning import let


def merged_windows(curves: DataFrame, days: float = 2.0) -> DataFrame:
    """Points merged from left to right: a block starts at the first point not
    yet used and takes all within ``days`` of it; mean time and flux of each.

    Blocks depend on those before, so a curve is one row's work; a block's end is
    found by bisection.
    """
    points = F.array_sort(F.collect_list(F.struct("t", "y", "s")))
    rows = curves.groupBy(*KEYS).agg(points.alias("p")).select(*KEYS, F.col("p")["t"].alias("pt"), F.col("p")["y"].alias("py"))

    def kernel(t: np.ndarray, y: np.ndarray) -> dict:
        starts = [0]
        while starts[-1] < len(t):
            at = starts[-1]
            end = int(np.searchsorted(t, t[at] + days, side="right"))
            while end < len(t) and t[end] - t[at] <= days:
                end += 1
            while end > at + 1 and t[end - 1] - t[at] > days:
                end -= 1
            starts.append(max(end, at + 1))
        n = np.diff(starts)
        return {"t": np.add.reduceat(t, starts[:-1]) / n, "y": np.add.reduceat(y, starts[:-1]) / n, "n": n}

    return mapped(rows, KEYS, kernel, "t double, y double, n long")


def counted(curves: DataFrame, more_than: int) -> DataFrame:
    """Rows of curves that have more than so many points."""
    enough = curves.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > more_than).select(*KEYS)
    return curves.join(enough, KEYS, "left_semi")


def prepared(curves: DataFrame, more_than: int = 20, days: float = 2.0) -> DataFrame:
    """Curves with enough points, merged, and still with enough points."""
    return counted(merged_windows(counted(curves, more_than), days), more_than)


def first_source(curves: DataFrame, *order: str) -> DataFrame:
    """The source of each component's first row in the order of columns: those
    that tell a file and a row's place in it, say."""
    return curves.groupBy("component").agg(F.min_by("source", F.struct(*order)).alias("source"))


def standardised(curves: DataFrame) -> DataFrame:
    """Adds z: flux less its median over a robust scale (median absolute
    deviation, else standard deviation, else 1)."""
    mid = curves.groupBy(*KEYS).agg(F.median("y").alias("mid"), F.stddev_pop("y").alias("std"))
    away = curves.join(mid, KEYS)
    mad = away.groupBy(*KEYS).agg((F.median(F.abs(F.col("y") - F.col("mid"))) * 1.4826).alias("mad"))
    scale = F.when(F.col("mad") > 1e-6, F.col("mad")).when(F.col("std") > 1e-6, F.col("std")).otherwise(1.0)
    return away.join(mad, KEYS).withColumn("z", (F.col("y") - F.col("mid")) / scale).drop("mid", "std", "mad")


def events(curves: DataFrame, last: int = 128) -> DataFrame:
    """Per point: standardised flux, log gap, relative time, slope
    (within 20) and its size; the last points of each curve only."""
    order = Window.partitionBy(*KEYS).orderBy("t", "y")
    whole = Window.partitionBy(*KEYS)
    rows = standardised(curves)
    gap = F.coalesce(F.col("t") - F.lag("t").over(order), F.lit(0.0))
    rows = rows.withColumns({"gap": gap, "dz": F.coalesce(F.col("z") - F.lag("z").over(order), F.lit(0.0)), "i": F.row_number().over(order), "size": F.count("*").over(whole)})
    span = F.max("t").over(whole) - F.min("t").over(whole)
    slope = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("dz") / F.greatest(F.col("gap"), F.lit(1e-3))))
    rows = rows.withColumns({"log_gap": F.log1p("gap"), "relative_t": F.when(span > 0, (F.col("t") - F.min("t").over(whole)) / span).otherwise(0.0), "slope": F.when(F.col("i") > 1, slope).otherwise(0.0)})
    return rows.where(F.col("i") > F.col("size") - last).select(*KEYS, "i", "t", "z", "log_gap", "relative_t", "slope", F.abs("slope").alias("slope_size"))


def derivative_channels(curves: DataFrame, width: int = 5) -> DataFrame:
    """Per point: gaps before and after, flux less its moving average, and first
    differences per day; neighbours of an end are the end itself."""
    order = Window.partitionBy(*KEYS).orderBy("t", "y")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    half = width // 2
    near = Window.partitionBy(*KEYS).orderBy("t", "y").rowsBetween(-half, half)
    missing = F.lit(float(width)) - F.count("z").over(near)
    edge = F.when(F.row_number().over(order) <= half, F.first("z").over(whole)).otherwise(F.last("z").over(whole))
    smooth = (F.sum("z").over(near) + missing * edge) / width
    before, after = F.col("t") - F.lag("t").over(order), F.lead("t").over(order) - F.col("t")
    rows = standardised(curves).withColumns({"before": before, "after": after, "highpass": F.col("z") - smooth, "rise": (F.lead("z").over(order) - F.col("z")) / F.greatest(after, F.lit(1e-3))})
    return rows.select(*KEYS, "t", "z", F.coalesce("before", "after", F.lit(0.0)).alias("gap_before"), F.coalesce("after", "before", F.lit(0.0)).alias("gap_after"), "highpass", F.abs("highpass").alias("highpass_size"), F.coalesce("rise", F.lag("rise").over(order), F.lit(0.0)).alias("rise"))


def gradient(value: str, time: str, order) -> Column:
    """The slope at each point from both neighbours, weighed by their distance;
    at a curve's ends, to the one neighbour. Times must differ."""
    y, t = F.col(value), F.col(time)
    y0, y1, back, ahead = F.lag(y).over(order), F.lead(y).over(order), t - F.lag(t).over(order), F.lead(t).over(order) - t
    inner = (back * back * y1 + (ahead * ahead - back * back) * y - ahead * ahead * y0) / (back * ahead * (ahead + back))
    return F.coalesce(inner, (y1 - y) / ahead, (y - y0) / back, F.lit(0.0))


def gradients(curves: DataFrame, scale: float = 8.0) -> DataFrame:
    """Per point: standardised flux, its first and second slope in time, each
    squeezed to between -1 and 1."""
    order = Window.partitionBy(*KEYS).orderBy("t", "y")
    rows = standardised(curves).withColumn("d1", gradient("z", "t", order))
    rows = rows.withColumn("d2", gradient("d1", "t", order))
    return rows.select(*KEYS, "t", "z", F.tanh(F.col("d1") / scale).alias("d1"), F.tanh(F.col("d2") / scale).alias("d2"))


def first_points(curves: DataFrame, most: int) -> DataFrame:
    """The first ``most`` points of each curve."""
    order = Window.partitionBy(*KEYS).orderBy("t", "y", "s")
    return curves.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).drop("i")


def globally_normalised(curves: DataFrame, mean: float, std: float) -> DataFrame:
    """Flux by the mean and deviation of a training set."""
    if not std > 1e-12:
        raise ValueError("the deviation of the training set must be above 1e-12")
    return curves.withColumn("y", (F.col("y") - mean) / std)


def masked_stats(padded: DataFrame, values: str, mask: str) -> DataFrame:
    """Adds the mean and deviation over the places of an array where a mask is true."""
    held = F.filter(F.zip_with(values, mask, lambda v, m: F.when(m, v)), lambda v: v.isNotNull())
    mean = F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(held), F.lit(1))
    rows = padded.withColumn("masked_mean", mean)
    square = F.aggregate(F.transform(held, lambda v: F.pow(v - F.col("masked_mean"), F.lit(2.0))), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn("masked_std", F.sqrt(square / F.greatest(F.size(held), F.lit(1))))


def series(curves: DataFrame) -> DataFrame:
    """One row a curve: its fluxes in order of time, as the panel of a series classifier."""
    points = F.array_sort(F.collect_list(F.struct("t", "y", "s")))
    return curves.groupBy(*KEYS).agg(points.alias("p")).select(*KEYS, F.col("p")["y"].alias("values"))


def renamed_for(domain: str, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction columns with the domain's name behind them."""
    return predictions.select(*[F.col(c).alias(c if c in keys else f"{c}_{domain}") for c in predictions.columns])


def without_scores(predictions: DataFrame, words: tuple[str, ...] = ("score", "prob")) -> DataFrame:
    """Predictions without the columns whose name has one of the words."""
    return predictions.drop(*[c for c in predictions.columns if any(w in c.lower() for w in words)])


def predicted(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds predicted: whether the score is at least the threshold; null without a score."""
    return scores.withColumn("predicted", F.col("score") >= threshold)


def most_likely(scores: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The n highest scores, ties by the keys."""
    return scores.where(F.col("score").isNotNull()).orderBy(F.desc("score"), *keys).limit(n)


def fused(forest: DataFrame, network: DataFrame) -> DataFrame:
    """Scores of two models by component, either may lack; positive if one says so."""
    both = forest.select("component", F.col("score").alias("forest_score"), F.col("predicted").alias("forest")).join(
        network.select("component", F.col("score").alias("network_score"), F.col("predicted").alias("network")), "component", "full"
    )
    return both.withColumn("positive", F.coalesce("forest", F.lit(False)) | F.coalesce("network", F.lit(False)))


def with_predictions(components: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every component once; one without a prediction is not positive."""
    return components.join(predictions.select("component", "positive"), "component", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def trained_forest(features: DataFrame, label: str, names: list[str], trees: int = 500, seed: int = 42, depth: int = 30) -> RandomForestClassificationModel:
    """A forest of deep trees, as many features tried at a split as the root of their number."""
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(features)
    return RandomForestClassifier(labelCol=label, numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed, maxDepth=depth).fit(rows)


def forest_scores(model: RandomForestClassificationModel, features: DataFrame, names: list[str], every: DataFrame, keys: list[str]) -> DataFrame:
    """The probability of label 1 of each row; rows of ``every`` whose features lack have null."""
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(features)
    found = model.transform(rows).select(*keys, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    return every.select(*keys).join(found, keys, "left")


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which half of the weight is reached."""
    order = Window.partitionBy(*keys).orderBy(value, weight)
    run = rows.withColumn("run", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(weight).over(Window.partitionBy(*keys)))
    return run.where(F.col("run") >= F.col("all") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def rolling_spread(curves: DataFrame, window: int = 15, least: int = 5, floor: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Adds the median of an odd number of points around each and their scaled
    median absolute deviation, cut off at a curve's ends and not below a floor."""
    half = max(window, least, 3) // 2
    near = F.collect_list("y").over(Window.partitionBy(*keys).orderBy("t", "y", "s").rowsBetween(-half, half))
    rows = curves.withColumn("near", near)

    def spread(o: Column) -> Column:
        def mid(x: Column) -> Column:
            n = F.size(x)
            return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2

        return let(mid(o), lambda m: F.struct(m.alias("rolling_median"), F.greatest(mid(F.array_sort(F.transform(o, lambda v: F.abs(v - m)))) * 1.4826, F.lit(floor)).alias("rolling_mad")))

    return rows.withColumn("spread", let(F.array_sort("near"), spread)).select(*curves.columns, "spread.*")
