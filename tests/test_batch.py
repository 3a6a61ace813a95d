"""Runs from files to tables: failures, resuming, command line."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.operators import spline_delay as S
from photoflow.operators.interpolation_delay import Scan
from photoflow.plans import batch
from photoflow.sources import sinks


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    t = np.linspace(0, 180, 46)
    f = lambda x: np.sin(x / 16) + 0.25 * np.cos(x / 6)
    rows = [("007", c, x, v, 0.03) for c, d in (("A", 0), ("B", 20)) for x, v in zip(t + d, f(t), strict=True)] + [("008", c, x, 1.0, 0.03) for c in "AB" for x in t[:3]]
    with open(folder / "curves.csv", "w", newline="") as out:
        csv.writer(out).writerows([("SourceID", "componentID", "jd", "flux", "flux_error"), *rows])
    with open(folder / "pairs.csv", "w", newline="") as out:
        csv.writer(out).writerows([("source_id", "component_a", "component_b"), ("007", "A", "B"), ("008", "A", "B"), ("009", "A", "B")])
    return folder


def test_interpolation_run(spark, files):
    how = Scan(least=-40, most=40, steps=81, grid=100, min_points=8)
    found = batch.interpolation_run(spark, str(files / "curves.csv"), str(files / "one"), str(files / "pairs.csv"), how, draws=3)
    assert {r.method for r in found["estimates"].collect()} == {"raw_on_interp", "interp_on_raw", "interp_on_interp", "combined"}
    assert all(abs(float(r.delay) - 20) < 1 and r.source_id == "007" for r in found["estimates"].collect())
    assert sorted(r.source_id for r in found["failed_systems"].collect()) == ["008", "009"]
    assert found["samples"].count() == 12 and all(abs(float(r["median"]) - 20) < 3 for r in found["summary"].collect())


def test_spline_run_goes_on_where_it_stopped(spark, files):
    folder = str(files / "two")
    found = batch.spline_run(spark, str(files / "curves.csv"), folder, str(files / "pairs.csv"), S.QUICK, draws=2)
    assert {r.source: r.delays is None for r in found["results"].collect()} == {"007": False, "008": True, "009": True}
    assert sorted(r.source for r in found["failed"].collect()) == ["008", "009"] and found["samples"].count() == 2
    assert abs(found["pair_delays"].first().delay - 20) < 1 and found["summary"].count() == 1
    again = batch.spline_run(spark, str(files / "curves.csv"), folder, str(files / "pairs.csv"), S.QUICK)
    assert again["results"].count() == 3 and again["samples"].count() == 2 and again["components"].first().component_j == "B"
    r = again["diagnostics"].first()
    assert len([c for c in again["diagnostics"].columns if c not in ("members", "delays")]) == 17
    assert (r.source_id, r.comp_A_reference, r.comp_B, r.K) == ("007", "A", "B", 15) and abs(r.delay_B_minus_A - 20) < 1 and r.forced_to_min_plotted_LOO and r.lambda_median > 0
    orphans = again["samples"].drop("bucket").withColumn("run", F.lit("died"))
    sinks.write_by_source(orphans, folder + "/samples")
    assert batch.written_samples(spark, again["results"], folder).count() == 2


def test_command_line(spark, files, capsys):
    batch.main(["spline", str(files / "curves.csv"), str(files / "three"), "--least", "15", "--most", "25", "--steps", "3"])
    assert "007" in capsys.readouterr().out
