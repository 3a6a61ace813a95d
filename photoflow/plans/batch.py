"""Whole delay runs, from files to result tables: all pairs or systems at once.

A run that is started again goes on where it stopped: systems that the results
folder has are not searched again. A system that fails is a row with a reason.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut, ship_package
from ..operators import delay_scan as A
from ..operators import pairs as P
from ..operators import spline_delay as S
from ..operators.interpolation_delay import Scan
from ..sources import sinks
from ..sources.curves import read_curves, read_pairs, valid

REASON = "no delay with enough overlap, or too few points"


def asked_pairs(spark: SparkSession, curves: DataFrame, path: str | None) -> DataFrame:
    """The pairs of a file, or all pairs of the curves."""
    return read_pairs(spark, path) if path else P.component_pairs(curves)


def interpolation_run(spark: SparkSession, curves_path: str, folder: str, pairs_path: str | None = None, how: Scan | None = None, draws: int = 0) -> dict[str, DataFrame]:
    """Estimates, profile and failed pairs, and with draws their samples and
    summary, written to ``folder`` as CSV; the tables are given back as read from there."""
    ship_package(spark)
    curves = cut(valid(read_curves(spark, curves_path)))
    pairs = cut(asked_pairs(spark, curves, pairs_path).select(*P.PAIR).distinct())
    sides = cut(P.with_sides(curves, pairs))
    estimates = cut(A.estimated(sides, how))
    failed = sinks.without_result(pairs, estimates)
    samples = summary = None
    if draws:
        samples = cut(A.drawn_delays(sides, how, draws))
        summary = P.sample_summary(samples, [*P.PAIR, "method"], "delay")
    sinks.write_delays(folder, estimates, A.scanned(sides, how), summary, samples, failed)
    names = ["estimates", "profile", "failed_systems", *(["summary", "samples"] if draws else [])]
    return {n: spark.read.option("header", True).csv(f"{folder}/{n}") for n in names}


def spline_run(spark: SparkSession, curves_path: str, folder: str, pairs_path: str | None = None, how: S.Search | None = None, draws: int = 0, seed: int = 123) -> dict[str, DataFrame]:
    """Systems of the asked pairs, or of all sources of 2 to 4 components, that
    ``folder`` has no result of: their delays with diagnostics, and with draws
    their samples. All tables so far are given back.

    Results and samples are appended under a run's id, results last; samples of a
    run that died before its results are never read. The other tables are made of
    them and written anew: diagnostics, pair_delays, failed, and with samples
    components and summary (of each component against the first, and of all pairs).
    """
    ship_package(spark)
    curves = cut(valid(read_curves(spark, curves_path)))
    if pairs_path:
        asked = read_pairs(spark, pairs_path).select("source", F.array("a", "b").alias("members")).distinct()
    else:
        asked = P.component_groups(curves)
    named = asked.withColumn("system", F.to_json("members"))
    run = uuid.uuid4().hex
    left = cut(sinks.unfinished(spark, named, f"{folder}/results", ("source", "system")))
    found = cut(S.spline_delays(curves, left.select(*S.SYSTEM), how).withColumn("system", F.to_json("members")))
    if draws:
        good = left.join(found.where("delays is not null").select("source", "system"), ["source", "system"], "left_semi")
        samples = S.drawn_delays(curves, good.select(*S.SYSTEM), how, draws, seed).withColumn("system", F.to_json("members"))
        sinks.write_by_source(samples.withColumn("run", F.lit(run)), f"{folder}/samples")
    sinks.write_by_source(found.withColumn("run", F.lit(run)), f"{folder}/results")  # last: a system counts as done with all its tables
    results = spark.read.parquet(f"{folder}/results")
    solved = results.where("delays is not null")
    tables = {"diagnostics": diagnostics(solved), "failed": results.where("delays is null").select("source", "members", "reason"), "pair_delays": named_pairs(S.delay_differences(solved, S.SYSTEM))}
    samples = written_samples(spark, results, folder)
    if samples is not None:
        spread = named_pairs(P.sample_summary(S.delay_differences(samples, [*S.SYSTEM, "draw"]), [*S.SYSTEM, "i", "j"], "delay"))
        tables |= {"summary": spread, "components": spread.where("i = 0")}
    sinks.write_delays(folder, None, **tables, form="parquet")
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in tables}
    return tables | {"results": results} | ({"samples": samples} if samples is not None else {})


def diagnostics(solved: DataFrame) -> DataFrame:
    """The numbers of each fit under the names that users of such tables know: fixed values."""
    names = {
        "cost": "cost", "loo": "loo_score", "loo_raw": "loo_score_raw", "bic": "bic_like", "n_knots": "K", "freedom": "df_eff", "most_leverage": "hat_diag_max", "base_penalty": "lambda_base",
        "median_penalty": "lambda_median", "n_overlap": "n_overlap", "span_frac": "span_frac", "least_frac": "min_frac_comp",
    }
    rows = solved.withColumn("loo_raw", F.col("loo"))
    place = [F.get("members", F.lit(i)).alias(n) for i, n in enumerate(("comp_A_reference", "comp_B"))]
    delay = (F.get("delays", F.lit(1)) - F.get("delays", F.lit(0))).alias("delay_B_minus_A")
    forced = F.coalesce(F.size("members") == 2, F.lit(False)).alias("forced_to_min_plotted_LOO")
    return rows.select(F.col("source").alias("source_id"), *place, delay, *[F.col(c).alias(n) for c, n in names.items()], forced, "members", "delays")


def named_pairs(rows: DataFrame) -> DataFrame:
    """Rows of places i and j of a system with the components there."""
    return rows.withColumns({"component_i": F.get("members", F.col("i")), "component_j": F.get("members", F.col("j"))})


def written_samples(spark: SparkSession, results: DataFrame, folder: str) -> DataFrame | None:
    """The samples of runs whose results were written too; None if there are none."""
    try:
        samples = spark.read.parquet(f"{folder}/samples")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return samples.join(results.select("source", "system", "run").distinct(), ["source", "system", "run"], "left_semi")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Time delays of pairs or systems of light curves.")
    parser.add_argument("method", choices=("interpolation", "spline"))
    parser.add_argument("curves", help="CSV or Parquet of measurements")
    parser.add_argument("folder", help="where result tables go")
    parser.add_argument("--pairs", help="CSV of pairs; all pairs otherwise")
    parser.add_argument("--least", type=float, default=-500.0)
    parser.add_argument("--most", type=float, default=500.0)
    parser.add_argument("--steps", type=int, default=400)
    parser.add_argument("--draws", type=int, default=0)
    given = parser.parse_args(arguments)
    run, how = (interpolation_run, Scan) if given.method == "interpolation" else (spline_run, S.Search)
    spark = SparkSession.builder.getOrCreate()
    tables = run(spark, given.curves, given.folder, given.pairs, how(least=given.least, most=given.most, steps=given.steps), given.draws)
    for name in ("estimates", "results", "pair_delays", "summary", "failed", "failed_systems"):
        if name in tables:
            print(name)
            tables[name].show(20, truncate=False)


if __name__ == "__main__":
    main()
