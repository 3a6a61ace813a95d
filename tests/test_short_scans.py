"""The short scans gather a pair's points once, whatever the number of delays and grid points."""

from photoflow.plans import pairs as plans


def test_short_scans_make_no_row_of_a_point_and_delay(spark):
    for name in ("d5_delay_scores", "d7_grid_argmin"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan, name
