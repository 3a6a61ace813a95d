import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.operators import interpolation_delay as D
from photoflow.operators import pairs as P


def curve_rows(component, delay, seed):
    t = np.sort(np.random.default_rng(seed).uniform(0, 180, 60))
    return [("s", component, float(x), math.sin((x - delay) / 16) + 0.25 * math.cos((x - delay) / 6), 0.03) for x in t]


@pytest.fixture(scope="module")
def sides(spark):
    rows = curve_rows("A", 0.0, 1) + curve_rows("B", 20.0, 2)
    curves = spark.createDataFrame(rows, "source string, component string, t double, y double, s double")
    return P.with_sides(curves, P.component_pairs(curves)).cache()


def test_known_delay_is_found(sides):
    found = {r.method: r.delay for r in D.estimated(sides, D.Scan(least=-40, most=40, steps=41)).collect()}
    assert set(found) == set(D.METHODS)
    assert all(abs(d - 20) < 1 for d in found.values())


def test_scores_agree_with_interp(sides):
    points = D.prepared(sides)
    rows = points.orderBy("t").collect()
    a = np.array([(r.t, r.y, r.s) for r in rows if r.side == "a"])
    b = np.array([(r.t - 12.5, r.y, r.s) for r in rows if r.side == "b"])
    lo, hi = max(a[0, 0], b[0, 0]), min(a[-1, 0], b[-1, 0])
    x = a[(a[:, 0] >= lo) & (a[:, 0] <= hi)]
    k = np.clip(np.searchsorted(b[:, 0], x[:, 0], side="right") - 1, 0, len(b) - 2)
    f = (x[:, 0] - b[k, 0]) / (b[k + 1, 0] - b[k, 0])
    d = x[:, 1] - np.interp(x[:, 0], b[:, 0], b[:, 1])
    v = x[:, 2] ** 2 + ((1 - f) * b[k, 2]) ** 2 + (f * b[k + 1, 2]) ** 2
    o = (d / v).sum() / (1 / v).sum()
    got = D.delay_scores(points, [12.5]).first()
    assert got.n_a == len(x)
    assert got.raw_on_interp == pytest.approx(((d - o) ** 2 / v).mean())


def test_draws_repeat_and_vary(sides):
    one, again = (D.draws(sides, 3, 7).groupBy("draw").agg(F.sum("y").alias("y")).orderBy("draw").collect() for _ in range(2))
    assert one == again and len({r.y for r in one}) == 3
    noise = D.draws(sides, 200, 7).join(sides.withColumnRenamed("y", "y0"), [*P.PAIR, "side", "t", "s"]).select(((F.col("y") - F.col("y0")) / F.col("s")).alias("z"))
    m = noise.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.03


def test_nearest_times_and_no_overlap(spark):
    rows = [("s", "A", 0.0, 1.0, 1.0), ("s", "A", 10.0, 1.0, 1.0), ("s", "B", 4.0, 1.0, 1.0), ("s", "B", 11.0, 1.0, 1.0)]
    curves = spark.createDataFrame(rows, "source string, component string, t double, y double, s double")
    sides = P.with_sides(curves, P.component_pairs(curves))
    near = P.nearest_times(sides).first()
    assert near.nn_median == 2.5 and near.nn_close_2d == 0.5
    assert D.delay_scores(D.prepared(sides), [500.0]).count() == 0
