"""Queries over the line items seen as curves: listing, binning, cleaning."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..sources.curves import KEYS, canonical, line_items, valid, with_known_names

LC = """lc AS (
  SELECT l_suppkey::VARCHAR AS source, l_returnflag AS component, epoch(l_shipdate) / 86400.0 + 2440587.5 AS t,
         l_extendedprice / 1000.0 AS y, 8 * (l_discount + 0.01) * l_extendedprice / 1000.0 AS s FROM lineitem)"""
BINS = LC + """, placed AS (SELECT *, floor((t - min(t) OVER (PARTITION BY source, component)) / 4.0)::BIGINT AS bin FROM lc),
b AS (SELECT source, component, bin, avg(t) AS t, avg(y) AS y, avg(s) FILTER (s > 0) AS s, count(*) AS n FROM placed GROUP BY source, component, bin)"""
SNR = BINS + """, m AS (
  SELECT source, component, count(*) AS n, (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2 AS signal,
         median(s) FILTER (s > 0) AS noise FROM b GROUP BY source, component)"""
#: Of the default settings, those that make both outcomes occur in these tables.
STRICT = C.Cleaning(min_snr=2.1, min_points_after=160)


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def canonical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names resolved, types cast, invalid measurements gone."""
    return rounded(valid(canonical(with_known_names(line_items(spark, sf_dir)))).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("y").alias("total")), 6)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).select("source").distinct()


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).select(*KEYS).distinct()


def bins(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return rounded(C.binned(line_items(spark, sf_dir), error_mode=mode).select(*KEYS, "bin", "t", "y", "s", "n"))


def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a column kept where a bin has one value of it."""
    curves = line_items(spark, sf_dir).withColumn("cents", F.pmod(F.round(F.col("y") * 1000).cast("long"), F.lit(2)).cast("string"))
    return C.binned(curves, others=("cents",)).select(*KEYS, "bin", "cents")


def snr(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    found = C.signal_to_noise(C.binned(line_items(spark, sf_dir)), mode)
    return rounded(found.select(*KEYS, "n", "signal", "noise", "snr", "noise_signal_ratio", "snr_reason"), 9)


def snr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.signal_to_noise(C.binned(line_items(spark, sf_dir))).withColumn("verdict", C.snr_verdict(STRICT))
    return found.select(*KEYS, F.col("verdict").isNotNull().alias("removed"), "verdict")


def rolling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = C.local_scores(C.binned(line_items(spark, sf_dir)).select(*KEYS, "bin", "t", "y", "s"))
    return rounded(scored.select(*KEYS, "bin", "local_median", "local_scale", "n_near", "z"))


def outlier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.clean(line_items(spark, sf_dir)).removed_points.select(*KEYS, "bin", "y", "z"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.clean(line_items(spark, sf_dir), STRICT).report, 9)


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.clean(line_items(spark, sf_dir), STRICT).clean.select(*KEYS, "bin", "t", "y", "s"))


def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean(line_items(spark, sf_dir), STRICT).removed_rows.select(*KEYS, "bin", "removed_reason")


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: binned, tested and cleaned points of each curve."""
    return C.clean(line_items(spark, sf_dir)).report.select(*KEYS, "n_after_binning", "n_removed_points", "n_final")


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.removal_counts(C.clean(line_items(spark, sf_dir), STRICT))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.clean(line_items(spark, sf_dir), STRICT).summary
    return found.select("input_rows", "input_groups", "rows_after_binning", "clean_rows", "removed_rows", "clean_groups", "removed_groups", "outlier_points")


def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_sources(line_items(spark, sf_dir), 5).groupBy(*KEYS).agg(F.count("*").alias("n"))


def bins_sql(error: str) -> str:
    return f"WITH {LC}, placed AS (SELECT *, floor((t - min(t) OVER (PARTITION BY source, component)) / 4.0)::BIGINT AS bin FROM lc) SELECT source, component, bin, round(avg(t), 8) AS t, round(avg(y), 8) AS y, round({error}, 8) AS s, count(*) AS n FROM placed GROUP BY source, component, bin"


def snr_sql(signal: str) -> str:
    return f"""WITH {BINS}, c AS (SELECT source, component, median(y) AS mid FROM b GROUP BY source, component),
    m AS (SELECT source, component, count(*) AS n, {signal} AS signal, median(s) FILTER (s > 0) AS noise FROM b JOIN c USING (source, component) GROUP BY source, component)
    SELECT source, component, n, round(signal, 9) AS signal, round(noise, 9) AS noise, round(signal / noise, 9) AS snr,
           round(noise / signal, 9) AS noise_signal_ratio, 'ok' AS snr_reason FROM m"""


SCORES = """, o AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY t, y, s) - 1 AS i, count(*) OVER (PARTITION BY source, component) AS size FROM b{where}),
w AS (SELECT *, greatest(0, least(i - 5, size - 11)) AS lo FROM o),
nb AS (SELECT w.source, w.component, w.bin, x.y AS v FROM w JOIN o AS x ON x.source = w.source AND x.component = w.component AND x.i >= w.lo AND x.i < w.lo + 11 AND x.i <> w.i),
c1 AS (SELECT source, component, bin, median(v) AS mid, count(*)::INTEGER AS n_near FROM nb GROUP BY ALL),
c2 AS (SELECT source, component, bin, any_value(mid) AS mid, any_value(n_near) AS n_near, 1.4826 * median(abs(v - mid)) AS mad FROM nb JOIN c1 USING (source, component, bin) GROUP BY ALL),
c3 AS (SELECT source, component, bin, any_value(mid) AS mid, any_value(n_near) AS n_near, any_value(mad) AS mad, sqrt(avg(least(abs(v - mid), 2.5 * mad) ** 2)) AS l2 FROM nb JOIN c2 USING (source, component, bin) GROUP BY ALL),
sc AS (SELECT source, component, bin, b.t, b.y, b.s, n_near, mid AS local_median, CASE WHEN mad > 0 THEN 0.7 * mad + 0.3 * l2 ELSE 0 END AS local_scale FROM c3 JOIN b USING (source, component, bin)),
z AS (SELECT *, CASE WHEN local_scale > 0 THEN (y - local_median) / local_scale END AS z FROM sc)"""
FLOW = (
    "WITH " + SNR + """, e AS (
  SELECT *, signal / noise AS snr, CASE WHEN signal / noise < {snr} THEN printf('bad_snr_low (snr=%.3f < min_snr=%.3f)', signal / noise, {snr}::DOUBLE) WHEN n < 3 THEN 'less_than_3_points_before_cleaning' END AS early FROM m)"""
    + SCORES.format(where=" SEMI JOIN (FROM e WHERE early IS NULL) AS ok USING (source, component)")
    + """, f AS (SELECT source, component, count(*) FILTER (abs(z) > 4) AS outliers, max(abs(z)) AS max_z FROM z GROUP BY ALL),
r AS (SELECT e.*, outliers, max_z, coalesce(early, CASE WHEN n - outliers < {after} THEN 'less_than_{after}_points_after_cleaning' WHEN outliers / n > 0.5 THEN 'too_many_outliers' END) AS reason
  FROM e LEFT JOIN f USING (source, component))"""
)
STRICT_FLOW, DEFAULT_FLOW = FLOW.format(snr=2.1, after=160), FLOW.format(snr=0.8, after=20)

QUERIES = {
    "slice0_clean_counts": clean_counts,
    "f1_canonical_scan": canonical_scan,
    "a22_list_sources": sources,
    "v3_list_components": components,
    **{f"a1_bin_{m}": partial(bins, mode=m) for m in ("mean", "quadrature", "sem")},
    "f13_bin_passthrough": passthrough,
    **{f"a5_snr_{m}": partial(snr, mode=m) for m in ("amplitude", "std", "robust_std")},
    "a6_snr_filter": snr_filter,
    "w1_rolling_score": rolling_scores,
    "w2_outlier_removed_points": outlier_points,
    "pre_source_report": report,
    "pre_clean": clean_rows,
    "pre_removed_rows": removed_rows,
    "a21_removal_counts": reasons,
    "a21_run_summary": run_summary,
    "t1_first_n_groups": first_groups,
}
ORACLE_SQL = {
    "slice0_clean_counts": DEFAULT_FLOW + " SELECT source, component, n AS n_after_binning, coalesce(outliers, 0) AS n_removed_points, CASE WHEN reason IS NULL THEN n - outliers ELSE 0 END AS n_final FROM r",
    "f1_canonical_scan": f"WITH {LC} SELECT source, component, count(*) AS n, round(sum(y), 6) AS total FROM lc WHERE s > 0 GROUP BY ALL",
    "a22_list_sources": f"WITH {LC} SELECT DISTINCT source FROM lc",
    "v3_list_components": f"WITH {LC} SELECT DISTINCT source, component FROM lc",
    "a1_bin_mean": bins_sql("avg(s) FILTER (s > 0)"),
    "a1_bin_quadrature": bins_sql("sqrt(sum(s * s) FILTER (s > 0)) / count(*) FILTER (s > 0)"),
    "a1_bin_sem": bins_sql("CASE WHEN count(*) > 1 THEN stddev_samp(y) / sqrt(count(*)) ELSE max(s) END"),
    "f13_bin_passthrough": f"WITH {LC}, placed AS (SELECT *, floor((t - min(t) OVER (PARTITION BY source, component)) / 4.0)::BIGINT AS bin, (round(y * 1000)::BIGINT % 2)::VARCHAR AS cents FROM lc) SELECT source, component, bin, CASE WHEN count(DISTINCT cents) = 1 THEN max(cents) END AS cents FROM placed GROUP BY source, component, bin",
    "a5_snr_amplitude": snr_sql("(quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2"),
    "a5_snr_std": snr_sql("stddev_pop(y)"),
    "a5_snr_robust_std": snr_sql("1.4826 * median(abs(y - mid))"),
    "a6_snr_filter": f"WITH {SNR} SELECT source, component, signal / noise < 2.1 AS removed, CASE WHEN signal / noise < 2.1 THEN printf('bad_snr_low (snr=%.3f < min_snr=%.3f)', signal / noise, 2.1::DOUBLE) END AS verdict FROM m",
    "w1_rolling_score": f"WITH {BINS}{SCORES.format(where='')} SELECT source, component, bin, round(local_median, 8) AS local_median, round(local_scale, 8) AS local_scale, n_near, round(z, 8) AS z FROM z",
    "w2_outlier_removed_points": DEFAULT_FLOW + " SELECT source, component, bin, round(y, 8) AS y, round(z, 8) AS z FROM z WHERE abs(z) > 4",
    "pre_source_report": STRICT_FLOW + """ SELECT source, component, n AS n_after_binning, round(signal, 9) AS signal, round(noise, 9) AS noise, round(snr, 9) AS snr, round(noise / signal, 9) AS noise_signal_ratio,
      'ok' AS snr_reason, reason IS NOT NULL AS removed_source, coalesce(reason, 'kept_after_adaptive_rolling_hybrid_cleaning') AS source_reason, coalesce(outliers, 0) AS n_removed_points,
      CASE WHEN reason IS NULL THEN n - outliers ELSE 0 END AS n_final, CASE WHEN early IS NULL THEN round(outliers / n, 9) END AS outlier_fraction, round(max_z, 9) AS max_abs_local_z FROM r""",
    "pre_clean": STRICT_FLOW + " SELECT source, component, bin, round(t, 8) AS t, round(z.y, 8) AS y, round(z.s, 8) AS s FROM z JOIN r USING (source, component) WHERE reason IS NULL AND NOT coalesce(abs(z) > 4, false)",
    "pre_removed_rows": STRICT_FLOW + " SELECT source, component, bin, CASE WHEN reason IS NOT NULL THEN reason ELSE 'adaptive_rolling_hybrid_outlier' END AS removed_reason FROM b JOIN r USING (source, component) LEFT JOIN z USING (source, component, bin) WHERE reason IS NOT NULL OR abs(z) > 4",
    "a21_removal_counts": STRICT_FLOW + " SELECT coalesce(reason, 'kept_after_adaptive_rolling_hybrid_cleaning') AS source_reason, count(*) AS n_groups FROM r GROUP BY ALL",
    "a21_run_summary": STRICT_FLOW + """ SELECT (SELECT count(*) FROM lc) AS input_rows, count(*) AS input_groups, sum(n)::BIGINT AS rows_after_binning, sum(CASE WHEN reason IS NULL THEN n - outliers ELSE 0 END)::BIGINT AS clean_rows,
      sum(n)::BIGINT - sum(CASE WHEN reason IS NULL THEN n - outliers ELSE 0 END)::BIGINT AS removed_rows, count(*) FILTER (reason IS NULL) AS clean_groups, count(*) FILTER (reason IS NOT NULL) AS removed_groups, coalesce(sum(outliers), 0)::BIGINT AS outlier_points FROM r""",
    "t1_first_n_groups": f"WITH {LC} SELECT source, component, count(*) AS n FROM lc WHERE source IN (SELECT DISTINCT source FROM lc ORDER BY source LIMIT 5) GROUP BY ALL",
}
