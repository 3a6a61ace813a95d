"""Whitening of embeddings by upper-triangle column aggregates.

Every dimension is a column, and one aggregation sums the centred products of
every pair of dimensions: generated SQL expressions, so that a task sends one
row of sums, whatever the number of vectors.  The driver gets the covariance,
whose size is the dimensions' alone, and decomposes it with LAPACK; the
projection is generated columns again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

COMPONENTS = 8
#: x = floor(SCALE * entry) + OFFSET; entries of LARGEST or more have no sums that fit a long.
SCALE, OFFSET, LARGEST = 1024, 100_000, float(1 << 24)
#: Sums that one aggregation makes; wider vectors take several over the same rows.
MOST_SUMS = 4096
#: A component whose share of the variance is not above this has none: nothing can be divided by its deviation.
LEAST_SHARE = 1e-12


def whole_entries(vector: Column) -> Column:
    """floor(1024 * entry) + 100000 of each entry; null unless all are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(LARGEST)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long")))


def total(terms: list[str], add: str = "({} + {})") -> str:
    """The sum of SQL terms, added in pairs so that no expression is deeper than the logarithm of their number."""
    while len(terms) > 1:
        terms = [add.format(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def number(value: float) -> str:
    return f"{float(value)!r}D"


def aggregated(rows: DataFrame, sums: list[str]) -> list:
    found: list = []
    for at in range(0, len(sums), MOST_SUMS):
        found += list(rows.selectExpr(*[f"{s} AS a{k}" for k, s in enumerate(sums[at : at + MOST_SUMS])]).first())
    return found


def symmetric(upper: list[float], width: int) -> np.ndarray:
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = upper
    return np.triu(full) + np.triu(full, 1).T


def upper_pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component (from 1, by falling variance),
    n, deviation, whitened, explained and identity_error.

    Vectors that are null or hold null or non-finite entries, or one of 2^24 or
    more, take no part. Entries that a shorter vector lacks count as 0. n is the
    number of vectors; deviation the exact sum over dimensions of (n * x - S)^2,
    null if no long can hold it; whitened the centred vector along the
    component over the component's deviation; explained the component's share
    of the variance; identity_error the largest absolute entry of the whitened
    columns' covariance, aggregated from them, minus the identity. Components
    without variance are left out, so equal vectors, a single one and an empty
    table give no rows. Rows that repeat count and are returned each, a null
    vec_id stays null, and columns beyond vec_id and embedding are not looked at.
    """
    rows = vectors.select("vec_id", whole_entries(F.col("embedding")).alias("x")).where("x is not null")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if not n or not width:
        return nothing
    columns = rows.selectExpr("vec_id", *[f"coalesce(get(x, {i}), {OFFSET}L) AS x{i}" for i in range(width)])
    sums = aggregated(columns, [f"sum(x{i})" for i in range(width)])
    centred = columns.selectExpr("vec_id", *[f"x{i}" for i in range(width)], *[f"x{i} - {number(s / n)} AS c{i}" for i, s in enumerate(sums)])
    products = aggregated(centred, [f"sum({a} * {b})" for a, b in upper_pairs([f"c{i}" for i in range(width)])])
    covariance = symmetric(products, width) / n
    values, directions = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > LEAST_SHARE * trace]
    if not order:
        return nothing
    along = [total([f"c{i} * {number(directions[i, k] / math.sqrt(values[k]))}" for i in range(width)]) for k in order]
    away = [f"try_subtract(try_multiply({n}L, x{i}), {s}L)" for i, s in enumerate(sums)]
    deviation = total([f"try_multiply({d}, {d})" for d in away], "try_add({}, {})")
    made = centred.selectExpr("vec_id", f"{deviation} AS deviation", *[f"{w} AS w{k}" for k, w in enumerate(along)])
    names = [f"w{k}" for k in range(len(order))]
    found = symmetric(aggregated(made, [f"covar_pop({a}, {b})" for a, b in upper_pairs(names)]), len(names))
    error = float(np.abs(found - np.eye(len(names))).max())
    parts = [F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(values[at]) / trace).alias("explained")) for k, at in enumerate(order)]
    each = made.select("vec_id", "deviation", F.explode(F.array(*parts)).alias("part"))
    return each.select("vec_id", F.col("part.component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("part.whitened"), F.col("part.explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE_SQL: dict[str, str] = {}
