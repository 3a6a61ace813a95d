"""Ingestion and cleaning against small tables and a plain rewrite of the rules."""

import numpy as np
import pytest

from photoflow.operators import cleaning as C
from photoflow.sources import curves as S


def test_aliases_and_types(spark):
    raw = spark.createDataFrame(
        [("9007199254740993", "1", "10.5", "nan", "1", "x"), ("9007199254740993", "1", "11", "2", "-1", None), (None, "1", "1", "1", "1", "x"), ("7", "1", "z", "1", "1", "x")],
        "sourceID string, comp string, JD string, Flux string, err string, note string",
    )
    rows = S.canonical(raw).collect()
    assert [(r.source, r.t, r.y, r.s) for r in rows] == [("9007199254740993", 11.0, 2.0, -1.0)]
    assert S.valid(S.canonical(raw)).count() == 0
    assert "note" in S.canonical(raw, keep_others=True).columns
    with pytest.raises(ValueError, match="component.*t "):
        S.canonical(raw.select("sourceID", "Flux"))


def test_flags_pairs_profiles_and_nesting(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", 1.0, 1.0, "True"), ("s", "a", 2.0, 1.0, "False"), ("s", "a", 0.5, 3.0, None)], "source string, component string, t double, y double, flag_outlier string")
    kept = S.canonical(df, without_flagged=True)
    assert sorted(r.t for r in kept.collect()) == [0.5, 2.0]
    assert sorted(r.t for r in S.flattened(S.nested(kept)).collect()) == [0.5, 2.0]
    (tmp_path / "pairs.csv").write_text("SourceID,comp_a,comp_b\n007,01,02\n")
    assert S.read_pairs(spark, str(tmp_path / "pairs.csv")).collect() == [("007", "01", "02")]
    assert S.profile('{"quick": {"_description": "x", "n": 3}}', "quick") == {"n": 3}
    with pytest.raises(KeyError, match="quick"):
        S.profile('{"quick": {}}', "slow")
    assert S.guess_time_column(["a", "obs_julian_day"]) == "obs_julian_day"


def plain_scores(y, half=5):
    n, w, out = len(y), 2 * half + 1, []
    for i in range(n):
        lo = max(0, min(i - half, n - w))
        v = np.array([y[j] for j in range(lo, min(n, lo + w)) if j != i])
        if not len(v):
            out.append(None)
            continue
        m = np.median(v)
        mad = 1.4826 * np.median(abs(v - m))
        scale = 0.7 * mad + 0.3 * np.sqrt(np.mean(np.clip(v - m, -2.5 * mad, 2.5 * mad) ** 2)) if mad > 0 else 0
        out.append((y[i] - m) / scale if scale > 0 else None)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 11, 12, 40])
def test_local_scores(spark, n):
    y = np.random.default_rng(n).normal(size=n).tolist()
    df = spark.createDataFrame([("s", "c", float(i), v, 1.0) for i, v in enumerate(y)], "source string, component string, t double, y double, s double")
    got = [r.z for r in C.local_scores(df).orderBy("t").collect()]
    for a, b in zip(got, plain_scores(y), strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b))


def test_cleaning_drops_a_spike_and_a_short_curve(spark):
    rows = [("s", "long", 4.0 * i, float(np.sin(i) + (50 if i == 20 else 0)), 0.05) for i in range(40)] + [("s", "short", 4.0 * i, float(i), 0.05) for i in range(5)]
    found = C.clean(spark.createDataFrame(rows, "source string, component string, t double, y double, s double"))
    report = {r.component: r for r in found.report.collect()}
    assert report["long"].n_removed_points == 1 and report["long"].n_final == 39
    assert report["short"].source_reason == "less_than_20_points_after_cleaning"
    assert found.clean.count() == 39 and found.removed_rows.count() == 6
    assert found.summary.first().clean_rows == 39


def test_cleaning_of_nothing(spark):
    empty = spark.createDataFrame([], "source string, component string, t double, y double, s double")
    found = C.clean(empty)
    assert found.clean.count() == 0 and found.report.count() == 0 and found.summary.first().input_rows == 0
