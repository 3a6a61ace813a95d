"""Shapes and scans of pairs, the generator, smooth lines and small helpers, against plain rewrites."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.operators import classification as K
from photoflow.operators import display as V
from photoflow.operators import pair_scan as Q
from photoflow.operators import pairs as P
from photoflow.operators import sampling as G
from photoflow.operators.cleaning import Cleaning
from photoflow.plans import pairs as plans
from photoflow.sources import curves as curve_files
from photoflow.sources import sinks

CURVE = "source string, component string, t double, y double, s double"
SMALL = "/root/testdata/sf0.001"


def rows_of(component, delay, seed, n=60):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 2000, n))
    return [("s", component, float(x), float(math.sin((x - delay) / 90) + 0.001 * x + rng.normal(0, 0.05)), 0.05) for x in t]


@pytest.fixture(scope="module")
def curves():
    return rows_of("A", 0, 1) + rows_of("B", 200, 2)


@pytest.fixture(scope="module")
def sides(spark, curves):
    table = spark.createDataFrame(curves, CURVE)
    return P.with_sides(table, P.component_pairs(table)).cache()


def poly(t, y, degree):
    x = (t - t.mean()) / (t.std() + 1e-8)
    c = np.polyfit(x, y, degree)
    return np.polyval(c, x), c


def test_shapes(spark, curves):
    found = {r.component: r for r in Q.shape_features(spark.createDataFrame(curves, CURVE), ["source", "component"]).collect()}
    for c in "AB":
        t, y = np.array([r[2:4] for r in curves if r[1] == c]).T
        r = found[c]
        for d, name in ((1, "trend_slope"), (2, "trend_quad"), (3, "trend_cubic")):
            assert r[name] == pytest.approx(poly(t, y, d)[1][0])
        for d in (1, 2, 3, 4):
            fit, c4 = poly(t, y, d)
            assert r[f"poly{d}_explained_frac"] == pytest.approx(1 - np.var(y - fit) / (np.var(y) + 1e-8))
            assert r[f"poly{d}_coef_l2"] == pytest.approx(np.linalg.norm(c4))
        rest = y - poly(t, y, 2)[0]
        assert (r.resid2_std, r.roughness) == pytest.approx((np.std(rest), np.std(np.diff(rest))))
        dy = np.diff(y) / np.sqrt(np.diff(t) + 1)
        assert r.dy_mad == pytest.approx(1.4826 * np.median(np.abs(dy - np.median(dy))))
    short = spark.createDataFrame([("s", "A", 1.0, 2.0, 0.1), ("s", "A", 2.0, 3.0, 0.1)], CURVE)
    assert all(v == 0 or k in ("resid2_std", "resid3_std", "roughness", "roughness3", "resid2_over_raw_std", "resid3_over_raw_std") for k, v in Q.shape_features(short, ["source"]).first().asDict().items() if k != "source")


def z(x):
    return (x - np.median(x)) / (1.4826 * np.median(np.abs(x - np.median(x))))


def test_scan_of_a_pair(sides, curves):
    delays = [-1900.0, -400.0, 0.0, 200.0, 205.5]
    found = {r.delay: r for r in Q.scan(sides, delays).collect()}
    (ta, ya), (tb, yb) = (np.array([r[2:4] for r in curves if r[1] == c]).T for c in "AB")
    assert found[-1900.0].n == 0 and found[-1900.0].combined == -1 and found[-1900.0].ml2_score == -1 and found[-1900.0].ml0_mae == 3
    assert found[200.0].combined > found[-400.0].combined and found[200.0].raw > 0.8
    for d in delays[1:]:
        inside = (ta >= tb[0] - d) & (ta <= tb[-1] - d)
        a, b = ya[inside], np.interp(ta[inside], tb - d, yb)
        r = found[d]
        assert (r.n, r.raw, r.raw_mae) == pytest.approx((inside.sum(), np.corrcoef(a, b)[0, 1], np.median(np.abs(z(a) - z(b)))))
        ra, rb = ya - poly(ta, ya, 2)[0], yb - poly(tb, yb, 2)[0]
        assert r.resid == pytest.approx(np.corrcoef(ra[inside], np.interp(ta[inside], tb - d, rb))[0, 1])
        gap = z(a) - z(b)
        slow, c = poly(ta[inside], gap, 3)
        assert r.ml3_corr == pytest.approx(np.corrcoef(z(a), z(b) + slow)[0, 1])
        assert r.ml3_cubic_abs == pytest.approx(abs(c[-4])) and r.ml3_slope_abs == pytest.approx(abs(c[-2]))
        assert r.ml0_resid_mad == pytest.approx(1.4826 * np.median(np.abs(gap - np.median(gap))))
        first, rest = 1.4826 * np.median(np.abs(gap - np.median(gap))), gap - slow
        left = 1.4826 * np.median(np.abs(rest - np.median(rest)))
        improve, var = (first - left) / (first + 1e-6), 1 - (np.std(rest) ** 2 + 1e-8) / ((np.std(gap) + 1e-8) ** 2 + 1e-8)
        score = 0.55 * r.ml3_corr + 0.25 * r.n / 60 + 0.25 * np.clip(improve, -1, 1) + 0.15 * np.clip(var, -1, 1) - 0.1 * min(np.median(np.abs(rest)), 5)
        assert r.ml3_score == pytest.approx(score)


def test_features_of_a_scan(sides):
    rows = Q.scan(sides, Q.DELAYS).orderBy("delay").collect()
    r = Q.scan_features(Q.scan(sides)).first()
    raw, mix = (np.array([x[c] for x in rows]) for c in ("raw", "combined"))
    top = int(np.argmax(mix))
    assert len(rows) == 161 and len(r.asDict()) == 3 + 325
    assert r.scan_raw_max == pytest.approx(raw.max()) and r.scan_raw_tau == rows[int(np.argmax(raw))].delay
    assert r.scan_raw_sharp_top1_top5 == pytest.approx(np.sort(raw)[-1] - np.sort(raw)[-6:-1].mean())
    assert r.scan_combined_top3_mean == pytest.approx(np.sort(mix)[-3:].mean()) and r.scan_resid_at_best == pytest.approx(rows[top].resid)
    assert r.scan_combined_zero == pytest.approx(mix[80]) and r.scan_combined_p95 == pytest.approx(np.percentile(mix, 95))
    scores = {d: np.array([x[f"ml{d}_score"] for x in rows]) for d in (0, 2)}
    assert r.ml_poly2_score_gain_vs_poly0 == pytest.approx(scores[2].max() - scores[0].max())
    assert r.ml_poly2_corr_at_best == pytest.approx(rows[int(np.argmax(scores[2]))].ml2_corr)
    assert r.ml_poly2_corr_at_best_combined_tau == pytest.approx(rows[top].ml2_corr)
    period = 2 * math.pi * 90  # the curves repeat, so the delay is one of several
    assert abs((r.scan_best_tau_combined - 200 + period / 2) % period - period / 2) < 25


def test_forest_leaves_failed_pairs_null(spark):
    rng = np.random.default_rng(4)
    rows = [("s", f"a{i}", "b", float(i % 2), float(i % 2 + rng.normal(0, 0.1)), float(rng.normal())) for i in range(60)]
    features = spark.createDataFrame(rows, "source string, a string, b string, label double, x double, w double")
    every = features.select("source", "a", "b").unionByName(spark.createDataFrame([("s", "failed", "b")], "source string, a string, b string"))
    model = K.trained_forest(features, "label", ["x", "w"], trees=10)
    found = {r.a: r.score for r in K.forest_scores(model, features, ["x", "w"], every, P.PAIR).collect()}
    assert len(found) == 61 and found.pop("failed") is None
    assert np.mean([(found[r[1]] > 0.5) == (r[3] == 1) for r in rows]) > 0.95


def test_gaussian_process_is_the_closed_form(spark, curves):
    found = V.gaussian_process(spark.createDataFrame(curves, CURVE).where("component = 'A'"), points=7).orderBy("t").collect()
    t, y, s = np.array([r[2:] for r in curves if r[1] == "A"]).T
    at, size = np.linspace(t[0], t[-1], 7), y.var()
    like = lambda a, b: size * np.exp(-0.5 * ((a[:, None] - b) / 180) ** 2)
    inverse = np.linalg.inv(like(t, t) + np.diag(np.maximum((0.05 * s) ** 2, 1e-6 * size)))
    assert [r.line for r in found] == pytest.approx(list(y.mean() + like(at, t) @ inverse @ (y - y.mean())), abs=1e-4)
    assert [r.sigma for r in found] == pytest.approx(list(np.sqrt(np.maximum(size - np.einsum("ij,jk,ik->i", like(at, t), inverse, like(at, t)), 0))), abs=1e-3)


def test_small_helpers(spark, tmp_path):
    rows = spark.createDataFrame([("s", "A", 45000.0, 1.0, 0.1), ("s", "B", 45010.0, 2.0, 0.1), ("r", "A", 45020.0, 5.0, 0.1)], CURVE)
    assert G.julian_from_any(rows, "t").first().t == 2445000.5
    assert G.julian_from_any(rows.withColumn("t", F.lit(2000.0)), "t").first().t == G.J2000
    assert G.julian_from_any(rows.withColumn("t", F.lit(5.0)), "t").first().t == 5.0
    assert G.decoded(spark.createDataFrame([(bytearray(b"ab"), 1)], "x binary, n int")).first().x == "ab"
    assert V.shown(rows, sources=["s"], components=["A", "B"]).count() == 2
    with pytest.raises(ValueError):
        V.shown(rows, components=["A", "B", "C"])
    assert V.in_mode(rows, "zscore").schema == V.in_mode(rows, "normalized").schema
    assert P.common_features(["a_x", "b_x", "a_y", "c"]) == ["x"]
    with pytest.raises(ValueError):
        K.globally_normalised(rows, 0.0, 0.0)
    flat = rows.groupBy("source").agg(P.guarded_corr("t", "y").alias("c"), P.guarded_moment("y", F.kurtosis("y")).alias("k")).collect()
    assert {(r.c, r.k) for r in flat} == {(0.0, 0.0)}
    few = P.looked_up(rows, spark.createDataFrame([("s", ["A", "B"]), ("r", ["A", "B"])], "source string, members array<string>"), 1)
    assert sorted((r.source, r.place) for r in few.collect()) == [("s", 0), ("s", 1)]
    kept = G.kept_by_chance(spark.range(2000), 0.3, 1, "id")
    assert 1300 < kept.count() < 1500
    assert sinks.unfinished(spark, rows.select("source", F.lit("x").alias("a"), F.lit("y").alias("b")), str(tmp_path / "not there")).count() == 3
    sinks.write_predictions(rows.select("source", "component", F.col("y").alias("score")), str(tmp_path / "p"), failures=rows.limit(1))
    assert [r.source for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()] == ["r", "s", "s"]
    sinks.write_delays(str(tmp_path / "d"), rows.withColumn("delays", F.array(F.lit(1.0))), summary=rows)
    assert spark.read.option("header", True).csv(str(tmp_path / "d" / "estimates")).first().delays == "[1.0]"


def test_merged_windows_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    t = np.sort(np.round(rng.uniform(0, 60, 80), 1))
    rows = [("s", "A", float(x), float(i), 0.1) for i, x in enumerate(t)]
    wanted, at = [], 0
    while at < len(t):
        block = [r for r in rows[at:] if r[2] - t[at] <= 2.0]
        wanted.append((np.mean([r[2] for r in block]), np.mean([r[3] for r in block]), len(block)))
        at += len(block)
    found = K.merged_windows(spark.createDataFrame(rows, CURVE)).orderBy("t").collect()
    assert [(r.t, r.y, r.n) for r in found] == [pytest.approx(w) for w in wanted]


def test_component_table_and_settings(spark):
    rows = [("s", c, 2459000.5 + i, float(i), 0.5) for c in "AB" for i in range(5)]
    table = spark.createDataFrame(rows, CURVE)
    found = V.component_table(table, ["A", "B"], "first=0", delays={"B": 2.0}, delay=-1.0, scales={"B": -2.0}, offsets={"A": 10.0}, window=3, most=3).orderBy("component", "t").collect()
    assert [(r.component, r.t - 2459000.5, r.y, r.s) for r in found] == [("A", -1.0, 10.0, 0.5), ("A", 1.0, 12.0, 0.5), ("A", 3.0, 14.0, 0.5), ("B", 2.0, 0.0, 1.0), ("B", 4.0, -4.0, 1.0), ("B", 6.0, -8.0, 1.0)]
    assert found[0].label == "component A | delay=-1.0 d" and found[4].smooth == -4.0 and str(found[3]["at"]) == "2020-06-02 00:00:00"
    plain = V.component_table(table, ["A"]).first()
    assert plain.label == "component A" and plain.smooth is None
    with pytest.raises(ValueError):
        V.component_table(table, ["A", "B", "C"])

    class Saved:
        bin_days, threshold = 2.0, 5.0

    assert curve_files.settings(Cleaning, {"bin_days": 1.0, "other": 3}) == Cleaning(bin_days=1.0)
    assert curve_files.settings(Cleaning, Saved()) == Cleaning(bin_days=2.0, threshold=5.0)
    assert curve_files.settings(Cleaning, {"days": 7.0}, bin_days="days").bin_days == 7.0 and curve_files.setting(None, "x", 4) == 4


def test_group_columns():
    assert curve_files.group_columns(["flux", "componentID", "source_id"]) == ["source_id", "componentID"]
    assert curve_files.group_columns(["componentID"]) == ["componentID"]
    with pytest.raises(ValueError):
        curve_files.group_columns(["flux"])


def test_slope_per_day(spark, curves):
    table = spark.createDataFrame([*curves, ("s", "C", 5.0, 1.0, 0.05)], CURVE)
    found = {r.component: r.trend_per_day for r in P.curve_features(table, ["source", "component"], per_day=True).collect()}
    for c in "AB":
        t, y = np.array([r[2:4] for r in curves if r[1] == c]).T
        assert found[c] == pytest.approx(np.polyfit(t, y, 1)[0])
    assert found["C"] == 0
    names = plans.QUERIES["p9_curve_features"](spark, SMALL).columns
    assert names.index("trend_per_day") == names.index("y_kurt") + 1 and len(names) == 27
