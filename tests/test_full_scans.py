"""The registered production scans on one small pair with a known delay."""

import math

import numpy as np
import pytest

from photoflow.operators import delay_scan as A
from photoflow.operators import pairs as P
from photoflow.plans import pairs as plans

DELAY = 311.3


@pytest.fixture(scope="module")
def curves():
    def rows(component, delay, seed):
        t = np.sort(np.random.default_rng(seed).uniform(0, 1500, 60))
        return [("s", component, float(x), math.sin((x - delay) / 90) + 0.5 * math.cos((x - delay) / 47), 0.03) for x in t]

    return rows("A", 0.0, 1) + rows("B", DELAY, 2)


@pytest.fixture
def sides(spark, curves, monkeypatch):
    table = spark.createDataFrame(curves, "source string, component string, t double, y double, s double")
    found = P.with_sides(table, P.component_pairs(table)).cache()
    monkeypatch.setattr(plans, "sides", lambda *_: found)
    return found


def test_refined_search_finds_a_long_delay(spark, sides):
    scores = plans.QUERIES["d5_full_delay_scores"](spark, "").collect()
    assert len(scores) == 400 and min(r.delay for r in scores) == -500 and max(r.delay for r in scores) == 500
    found = {r.method: (r.delay, r.score) for r in plans.QUERIES["d7_refined_delays"](spark, "").collect()}
    for method, (delay, score) in found.items():
        assert abs(delay - DELAY) < 3
        assert score <= min(r[method] for r in scores)


def test_monte_carlo_draws(spark, sides, monkeypatch):
    asked, run = [], plans.A.drawn_delays

    def seen(table, how, n, refine):
        asked.append((how, n, refine))
        return run(table, how, n, refine=refine)

    monkeypatch.setattr(plans.A, "drawn_delays", seen)
    rows = plans.QUERIES["d8_monte_carlo"](spark, "").collect()
    assert asked == [(plans.D.Scan(), 200, True)]
    assert {r.method for r in rows} == set(plans.D.METHODS)
    assert all(r.n_valid == 200 and abs(r["median"] - DELAY) < 3 for r in rows)


def test_draws_are_those_of_a_plain_loop(spark, sides, curves):
    how = A.Scan(least=250.0, most=350.0, steps=21)
    found = {(r.draw, r.method): (r.delay, r.score) for r in A.drawn_delays(sides, how, 3, seed=7).collect()}
    a, b = (np.array([r[2:] for r in curves if r[1] == c]).T for c in "AB")
    for draw in (1, 2, 3):
        z = A.normals(7, '["s","A","B"]', draw, 120)
        moved = spark.createDataFrame(
            [("s", c, float(t), float(y + s * e), float(s)) for c, (ts, ys, ss), es in (("A", a, z[:60]), ("B", b, z[60:])) for t, y, s, e in zip(ts, ys, ss, es, strict=True)],
            "source string, component string, t double, y double, s double",
        )
        plain = plans.D.estimated(P.with_sides(moved, P.component_pairs(moved)), how, refine=False)
        for r in plain.collect():
            delay, score = found[draw, r.method]
            assert score <= r.score + 1e-9 and abs(delay - r.delay) <= 10.01


def test_array_scan_is_the_scan_of_rows(spark, sides):
    how = A.Scan(steps=21, overlap_penalty=2.0)
    points = plans.D.prepared(sides)
    rows = {r.delay: r for r in plans.D.delay_scores(points, how.delays(), how).collect()}
    arrays = {r.delay: r for r in A.scanned(sides, how).collect()}
    assert set(rows) == set(arrays) and len(rows) > 5
    for d, r in rows.items():
        for c in ("n_a", "n_b", "frac_a", "frac_b", "span_frac", *plans.D.METHODS):
            assert arrays[d][c] == pytest.approx(r[c], rel=1e-9), (d, c)
    best = {r.method: r.delay for r in A.estimated(sides, how, refine=False).collect()}
    assert best == {r.method: r.delay for r in plans.D.estimated(sides, how, refine=False).collect()}


def plain_correlations(curves, delay):
    (ta, ya), (tb, yb) = (np.array([(r[2], r[3]) for r in curves if r[1] == c]).T for c in "AB")
    inside = (ta >= (tb - delay).min()) & (ta <= (tb - delay).max())
    if inside.sum() < 5:
        return 0, 0.0, 3.0
    a, b = ya[inside], np.interp(ta[inside], tb - delay, yb)
    za, zb = ((x - np.median(x)) / (1.4826 * np.median(np.abs(x - np.median(x)))) for x in (a, b))
    return int(inside.sum()), np.corrcoef(a, b)[0, 1], np.median(np.abs(za - zb))


def test_correlations_of_all_delays(spark, sides, curves):
    rows = plans.QUERIES["p11_full_delay_correlations"](spark, "").collect()
    assert sorted(r.delay for r in rows) == np.linspace(-805, 805, 161).round(7).tolist()
    for r in rows:
        assert (r.n, r.corr, r.mae) == pytest.approx(plain_correlations(curves, r.delay), abs=1e-6)
    found = plans.QUERIES["a17_full_profile_summary"](spark, "").first()
    corr = sorted((r.corr for r in rows), reverse=True)
    assert found.top == pytest.approx(corr[0]) and abs(found.top_delay - DELAY) < 10.1
    assert found.stands_out == pytest.approx(corr[0] - np.mean(corr[1:6]), abs=1e-6)


def test_all_features_are_contrasted(spark, sides):
    found = plans.QUERIES["p16_full_contrasts"](spark, "")
    assert {f"diff_signed_{c}" for c in plans.FEATURES.split()} <= set(found.columns) and len(found.columns) == 3 + 5 * 24
    assert found.count() == 1
