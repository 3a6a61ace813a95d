"""Queries over pairs of components: features, interpolation, delays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut
from ..operators import delay_scan as A
from ..operators import interpolation_delay as D
from ..operators import packing as K
from ..operators import pair_scan as Q
from ..operators import pairs as P
from ..operators.cleaning import binned
from ..sources.curves import KEYS, line_items
from .cleaning import BINS, LC, rounded

DELAYS = [-40.0, -20.0, 0.0, 20.0, 40.0]
SCAN = D.Scan(least=-40.0, most=40.0, steps=5, grid=50)
#: The production scan: 400 delays of -500 to 500 days, 200 grid points; 200 draws.
FULL_SCAN, DRAWS = D.Scan(), 200
#: The reference's scan of correlations: 161 delays of -805 to 805 days.
FULL_DELAYS = D.Scan(least=-805.0, most=805.0, steps=161).delays()
CONTRASTED = ["n", "y_std", "gap_max"]


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(line_items(spark, sf_dir)).select(*KEYS, "t", "y", "s")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(curves(spark, sf_dir))
    return cut(P.with_sides(rows, P.component_pairs(rows, P.LEAST_POINTS)))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.component_pairs(line_items(spark, sf_dir))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.packed(P.stretched(sides(spark, sf_dir)))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: every packed point's channels, and how long the padded curve is."""
    rows = packed(spark, sf_dir).select(*K.KEYS, F.size("x").alias("length"), F.posexplode(F.arrays_zip("x", "mask")).alias("i", "p"))
    named = [(F.round(F.get("p.x", F.lit(k)).cast("double"), 4) + 0.0).alias(c) for k, c in enumerate(K.CHANNELS)]
    return rows.where("p.mask = 1").select(*K.KEYS, "length", "i", *named)


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P3: points as models of pairs see them, as sums per side."""
    return rounded(K.unpacked(packed(spark, sf_dir)).groupBy(*K.KEYS).agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum("y").alias("flux"), F.sum("s").alias("error")), 3)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.pair_stats(packed(spark, sf_dir)), 5)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.curve_features(curves(spark, sf_dir).withColumn("t", F.col("t") - 2449000.0), KEYS, per_day=True), 11)


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.cadence(P.stretched(sides(spark, sf_dir))), 6)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.nearest_times(sides(spark, sf_dir)), 6)


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.curve_features(P.stretched(sides(spark, sf_dir)), [*P.PAIR, "side"])
    return rounded(P.contrasts(found, CONTRASTED), 6)


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.correlations(sides(spark, sf_dir), DELAYS), 7)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.profile_summary(Q.correlations(sides(spark, sf_dir), DELAYS), P.PAIR, "delay", "corr"), 7)


def full_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.scan_correlations(sides(spark, sf_dir), FULL_DELAYS), 7)


def full_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.profile_summary(Q.scan_correlations(sides(spark, sf_dir), FULL_DELAYS), P.PAIR, "delay", "corr"), 7)


def full_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.curve_features(P.stretched(sides(spark, sf_dir)), [*P.PAIR, "side"])
    return rounded(P.contrasts(found, [c for c in found.columns if c not in (*P.PAIR, "side")]), 6)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.merged_epochs(line_items(spark, sf_dir), KEYS))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(line_items(spark, sf_dir).groupBy(*KEYS).agg(P.weighted_mean(F.col("y"), F.col("s") * F.col("s")).alias("mean")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.sample_summary(line_items(spark, sf_dir), KEYS, "y"), 9)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.prepared(sides(spark, sf_dir)), 7)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.scanned(sides(spark, sf_dir), SCAN), 6)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.estimated(sides(spark, sf_dir), SCAN, refine=False), 6)


def full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.scanned(sides(spark, sf_dir), FULL_SCAN), 6)


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.estimated(sides(spark, sf_dir), FULL_SCAN), 6)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monte Carlo: the refined production scan of every draw of each pair, summarised."""
    return P.sample_summary(A.drawn_delays(sides(spark, sf_dir), FULL_SCAN, DRAWS, refine=True), [*P.PAIR, "method"], "delay")


SIDES = f"""WITH {BINS}, u AS (SELECT DISTINCT source, component FROM b), pr AS (SELECT x.source, x.component AS a, y.component AS b FROM u AS x JOIN u AS y ON x.source = y.source AND x.component < y.component),
sd AS (SELECT pr.source, pr.a, pr.b, CASE WHEN b.component = pr.a THEN 'a' ELSE 'b' END AS side, b.t, b.y, b.s FROM pr JOIN b ON b.source = pr.source AND (b.component = pr.a OR b.component = pr.b))"""
STRETCHED = SIDES + """, sp AS (SELECT source, a, b, min(t) AS t0, max(t) AS t1 FROM sd GROUP BY ALL),
st AS (SELECT source, a, b, side, (t - t0) * (2000.0 / greatest(t1 - t0, 1.0)) AS t, y, s FROM sd JOIN sp USING (source, a, b))"""


_SIDE = "source, a, b, side"
PACKED = STRETCHED + f""", f1 AS (SELECT {_SIDE}, t, y, s FROM st),
f2 AS (SELECT {_SIDE}, median(y) AS mid, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, stddev_pop(y) AS std FROM f1 GROUP BY ALL),
f3 AS (SELECT {_SIDE}, median(abs(y - mid)) AS mad, any_value(mid) AS mid, any_value(iqr) AS iqr, any_value(std) AS std FROM f1 JOIN f2 USING ({_SIDE}) GROUP BY {_SIDE}),
f4 AS (SELECT *, CASE WHEN 1.4826 * mad >= 1e-6 THEN 1.4826 * mad WHEN iqr / 1.349 >= 1e-6 THEN iqr / 1.349 WHEN std >= 1e-6 THEN std ELSE 1 END AS scale FROM f3),
f5 AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(t - lag(t) OVER w, 0) AS gap FROM f1 WINDOW w AS (PARTITION BY {_SIDE} ORDER BY t, y, s)),
pk AS (SELECT {_SIDE}, i, t, mid, scale, (t / 2000)::FLOAT AS t_norm, (ln(1 + gap) / ln(2001.0::DOUBLE))::FLOAT AS log_gap, ((y - mid) / scale)::FLOAT AS flux_norm, greatest(1e-4, least(5, CASE WHEN s > 0 THEN s ELSE mad * 0.05 + 1e-3 END / scale))::FLOAT AS error_norm,
  sin(2 * pi() * t / 2000)::FLOAT AS sin_t, cos(2 * pi() * t / 2000)::FLOAT AS cos_t FROM f5 JOIN f4 USING ({_SIDE}) WHERE i < 213),
pi AS (SELECT {_SIDE}, any_value(mid) AS mid, any_value(scale) AS scale, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM pk GROUP BY ALL)"""


def features_sql(table: str, keys: str, time: str = "t") -> str:
    return f"""o AS (SELECT *, {time} AS tt, {time} - lag({time}) OVER w AS gap, lag(y) OVER w AS y0 FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY t, y, s)),
    o2 AS (SELECT *, CASE WHEN gap > 1e-5 THEN (y - y0) / sqrt(gap + 1) END AS dy, avg(y) OVER v AS my, median(y) OVER v AS md FROM o WINDOW v AS (PARTITION BY {keys})),
    ft AS (SELECT {keys}, count(*) AS n, max(tt) - min(tt) AS span, min(tt) AS t_start, max(tt) AS t_end, avg(gap) AS gap_mean, median(gap) AS gap_median, stddev_pop(gap) AS gap_std, max(gap) AS gap_max,
      quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) AS gap_iqr, avg(y) AS y_mean, stddev_pop(y) AS y_std, median(y) AS y_median, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS y_iqr,
      quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS y_amp_q90, min(y) AS y_min, max(y) AS y_max, avg((y - my) ** 3) / stddev_pop(y) ** 3 AS y_skew, avg((y - my) ** 4) / stddev_pop(y) ** 4 - 3 AS y_kurt,
      regr_slope(y, tt) AS trend_per_day, sqrt(var_pop(y) * (1 - regr_r2(y, tt))) AS resid1_std, corr(y0, y) AS acf1, stddev_pop(dy) AS dy_std, median(s) AS err_median, avg(s) AS err_mean, 1.4826 * median(abs(y - md)) AS y_mad
      FROM o2 GROUP BY {keys})"""


NEAREST = """pa AS (SELECT * FROM {0} WHERE side = 'a'), pb AS (SELECT * FROM {0} WHERE side = 'b'),
n0 AS (SELECT pa.*, pb.t AS before FROM pa ASOF LEFT JOIN pb ON pa.source = pb.source AND pa.a = pb.a AND pa.b = pb.b AND pa.t >= pb.t),
n1 AS (SELECT n0.*, pb.t AS after FROM n0 ASOF LEFT JOIN pb ON n0.source = pb.source AND n0.a = pb.a AND n0.b = pb.b AND n0.t <= pb.t),
nn AS (SELECT source, a, b, median(least(t - before, after - t)) AS nn_median, quantile_cont(least(t - before, after - t), 0.9) AS nn_p90, avg((least(t - before, after - t) <= 2.0)::INT) AS nn_close_2d,
  avg((least(t - before, after - t) <= 10.0)::INT) AS nn_close_10d FROM n1 GROUP BY ALL)"""
LINE = "{x}0.y * (1 - {f}) + {x}1.y * {f}"
PREPARED = SIDES + """, k1 AS (SELECT source, a, b, side, median(y) AS mid, stddev_pop(y) AS std FROM sd GROUP BY ALL), k2 AS (SELECT sd.*, y - mid AS c, std, min(t) OVER (PARTITION BY source, a, b) AS t0 FROM sd JOIN k1 USING (source, a, b, side)),
k3 AS (SELECT source, a, b, side, 1.4826 * median(abs(c)) AS mad, max(std) AS std FROM k2 GROUP BY ALL), k4 AS (SELECT *, CASE WHEN mad > 1e-12 THEN mad WHEN std > 1e-12 THEN std ELSE 1 END AS scale FROM k3),
k5 AS (SELECT source, a, b, side, t - t0 AS t, c / scale AS y, greatest(s / scale, 0.05) AS s FROM k2 JOIN k4 USING (source, a, b, side)),
p AS (SELECT source, a, b, side, t, sum(y / s ** 2) / sum(1 / s ** 2) AS y, sqrt(1 / sum(1 / s ** 2)) AS s FROM k5 GROUP BY ALL)"""
_ON = "q.source = x.source AND q.a = x.a AND q.b = x.b AND q.delay = x.delay AND q.t {} x.t"
SCORES = PREPARED + """, ex AS (SELECT source, a, b, min(t) FILTER (side = 'a') AS a0, max(t) FILTER (side = 'a') AS a1, min(t) FILTER (side = 'b') AS b0, max(t) FILTER (side = 'b') AS b1 FROM p GROUP BY ALL),
ov AS (SELECT source, a, b, d::DOUBLE AS delay, greatest(a0, b0 - d) AS st, least(a1, b1 - d) AS en, (least(a1, b1 - d) - greatest(a0, b0 - d)) / greatest(least(a1 - a0, b1 - b0), 1e-12) AS span_frac FROM ex, (VALUES (-40.0::DOUBLE), (-20.0), (0.0), (20.0), (40.0)) AS v(d)),
mv AS (SELECT ov.*, side, CASE WHEN side = 'b' THEN t - delay ELSE t END AS t, y, s FROM ov JOIN p USING (source, a, b) WHERE en > st AND span_frac >= 0.5),
ga AS (SELECT ov.*, 'g' AS side, CASE WHEN i = 49 THEN en ELSE st + i * ((en - st) / 49) END AS t, NULL::DOUBLE AS y, NULL::DOUBLE AS s FROM ov, range(50) AS r(i) WHERE en > st AND span_frac >= 0.5),
q0 AS (FROM mv UNION ALL FROM ga),
q1 AS (SELECT q.*, {t: x.t, y: x.y, s: x.s} AS xa0 FROM q0 AS q ASOF LEFT JOIN (FROM mv WHERE side = 'a') AS x ON """ + _ON.format(">=") + """),
q2 AS (SELECT q.*, {t: x.t, y: x.y, s: x.s} AS xa1 FROM q1 AS q ASOF LEFT JOIN (FROM mv WHERE side = 'a') AS x ON """ + _ON.format("<=") + """),
q3 AS (SELECT q.*, {t: x.t, y: x.y, s: x.s} AS xb0 FROM q2 AS q ASOF LEFT JOIN (FROM mv WHERE side = 'b') AS x ON """ + _ON.format(">=") + """),
q4 AS (SELECT q.*, {t: x.t, y: x.y, s: x.s} AS xb1 FROM q3 AS q ASOF LEFT JOIN (FROM mv WHERE side = 'b') AS x ON """ + _ON.format("<=") + """),
q5 AS (SELECT *, CASE WHEN xa1.t > xa0.t THEN (t - xa0.t) / (xa1.t - xa0.t) WHEN xa1.t = xa0.t THEN 0 END AS fa, CASE WHEN xb1.t > xb0.t THEN (t - xb0.t) / (xb1.t - xb0.t) WHEN xb1.t = xb0.t THEN 0 END AS fb FROM q4),
q6 AS (SELECT *, xa0.y * (1 - fa) + xa1.y * fa AS ya, ((1 - fa) * xa0.s) ** 2 + (fa * xa1.s) ** 2 AS va, xb0.y * (1 - fb) + xb1.y * fb AS yb, ((1 - fb) * xb0.s) ** 2 + (fb * xb1.s) ** 2 AS vb, t BETWEEN st AND en AS ins FROM q5),
q7 AS (SELECT *, CASE side WHEN 'a' THEN y - yb WHEN 'b' THEN ya - y ELSE ya - yb END AS d, CASE side WHEN 'a' THEN s * s + vb WHEN 'b' THEN va + s * s ELSE va + vb END AS v FROM q6),
q8 AS (SELECT source, a, b, delay, side, sum(d / v) / sum(1 / v) AS o FROM q7 WHERE ins AND v > 0 AND d IS NOT NULL GROUP BY ALL),
q9 AS (SELECT source, a, b, delay, side, avg((d - o) ** 2 / v) AS score FROM q7 JOIN q8 USING (source, a, b, delay, side) WHERE ins AND v > 0 AND d IS NOT NULL GROUP BY ALL),
ns AS (SELECT source, a, b, delay, span_frac, count(*) FILTER (side = 'a' AND ins) AS n_a, count(*) FILTER (side = 'b' AND ins) AS n_b, avg(ins::INT) FILTER (side = 'a') AS frac_a, avg(ins::INT) FILTER (side = 'b') AS frac_b FROM q7 GROUP BY ALL),
s AS (SELECT ns.*, x.score AS raw_on_interp, y.score AS interp_on_raw, z.score AS interp_on_interp, (x.score + y.score + z.score) / 3 AS combined FROM ns JOIN q9 AS x USING (source, a, b, delay) JOIN q9 AS y USING (source, a, b, delay) JOIN q9 AS z USING (source, a, b, delay)
  WHERE x.side = 'a' AND y.side = 'b' AND z.side = 'g' AND least(n_a, n_b) >= 10 AND least(frac_a, frac_b) >= 0.5)"""  # fmt: skip
CORRELATIONS = SIDES + """, dm AS (SELECT source, a, b, side, d::DOUBLE AS delay, CASE WHEN side = 'b' THEN t - d ELSE t END AS t, y FROM sd, (VALUES (-40.0::DOUBLE), (-20.0), (0.0), (20.0), (40.0)) AS v(d)),
r1 AS (SELECT q.source, q.a, q.b, q.delay, q.t, q.y, x.t AS t0, x.y AS y0 FROM (FROM dm WHERE side = 'a') AS q ASOF JOIN (FROM dm WHERE side = 'b') AS x ON """ + _ON.format(">=") + """),
r2 AS (SELECT q.*, CASE WHEN x.t > t0 THEN y0 + (x.y - y0) * (q.t - t0) / (x.t - t0) ELSE y0 END AS other FROM r1 AS q ASOF JOIN (FROM dm WHERE side = 'b') AS x ON """ + _ON.format("<=") + """),
cr AS (SELECT source, a, b, delay, count(*) AS n, corr(y, other) AS corr, avg(abs(y - other)) AS mae FROM r2 GROUP BY ALL HAVING count(*) >= 5)"""


def all_rounded(names: str, places: int, whole: tuple[str, ...] = ("n",)) -> str:
    return ", ".join(x if x in whole else f"round({x}, {places}) AS {x}" for x in names.split())


FEATURES = "n span t_start t_end gap_mean gap_median gap_std gap_max gap_iqr y_mean y_std y_median y_iqr y_amp_q90 y_min y_max y_skew y_kurt resid1_std acf1 dy_std err_median err_mean y_mad"
CURVE_FEATURES = FEATURES.replace("y_kurt", "y_kurt trend_per_day")
QUERIES = {
    "j5_component_pairs": pairs,
    "p1_packed": channels,
    "p2_unpacked": restored,
    "p4_pair_stats": stats,
    "p9_curve_features": features,
    "p15_cadence": cadence,
    "p16_contrasts": contrasts,
    "j11_nearest_time": nearest,
    "p11_delay_correlations": correlations,
    "a17_profile_summary": summaries,
    "a12_duplicate_epochs": epochs,
    "a11_weighted_mean": weighted,
    "a18_sample_summary": samples,
    "d1_prepared_pairs": prepared,
    "d5_delay_scores": scores,
    "d7_grid_argmin": best,
    "d8_monte_carlo": drawn,
    "d5_full_delay_scores": full_scores,
    "d7_refined_delays": refined,
    "p11_full_delay_correlations": full_correlations,
    "a17_full_profile_summary": full_summaries,
    "p16_full_contrasts": full_contrasts,
}
ORACLE_SQL = {
    "j5_component_pairs": f"WITH {LC}, u AS (SELECT DISTINCT source, component FROM lc) SELECT x.source, x.component AS a, y.component AS b FROM u AS x JOIN u AS y ON x.source = y.source AND x.component < y.component",
    "p1_packed": PACKED + f""" SELECT source, a, b, side, 213 AS length, i::INTEGER AS i, {", ".join(f"round({c}::DOUBLE, 4) + 0.0::DOUBLE AS {c}" for c in K.CHANNELS)} FROM pk""",
    "p2_unpacked": PACKED + " SELECT source, a, b, side, count(*) AS n, round(max(t_norm::DOUBLE * 2000), 3) AS last, round(sum(flux_norm::DOUBLE), 3) AS flux, round(sum(error_norm::DOUBLE), 3) AS error FROM pk GROUP BY source, a, b, side",
    "p4_pair_stats": PACKED + """ SELECT x.source, x.a, x.b, round((y.mid - x.mid) / 3, 5) AS median_difference, round(ln((y.scale + 1e-3) / (x.scale + 1e-3)), 5) AS scale_ratio, round(x.n / 213, 5) AS n_a, round(y.n / 213, 5) AS n_b,
      round(greatest(0, least(x.t1, y.t1) - greatest(x.t0, y.t0)) / 2000, 5) AS overlap, round((y.t1 - y.t0) / 2000 - (x.t1 - x.t0) / 2000, 5) AS span_difference FROM pi AS x JOIN pi AS y USING (source, a, b) WHERE x.side = 'a' AND y.side = 'b'""",
    "p9_curve_features": f"WITH {BINS}, {features_sql('b', 'source, component', 't - 2449000.0')} SELECT source, component, {all_rounded(CURVE_FEATURES, 11)} FROM ft".replace("FROM b WINDOW", "FROM (SELECT source, component, t, y, s FROM b) AS b WINDOW"),
    "p15_cadence": STRETCHED + ", " + NEAREST.format("st") + """, gp AS (SELECT *, t - lag(t) OVER (PARTITION BY source, a, b, side ORDER BY t, y, s) AS gap FROM st),
      g AS (SELECT source, a, b, side, count(*) AS n, min(t) AS t0, max(t) AS t1, median(gap) AS gm, stddev_pop(gap) AS gs, max(gap) AS gx FROM gp GROUP BY ALL)
      SELECT source, a, b, abs(x.n - y.n) AS n_difference, round(abs(x.gm - y.gm), 6) AS gap_median_difference, round(abs(x.gs - y.gs), 6) AS gap_std_difference, round(abs(x.gx - y.gx), 6) AS gap_max_difference,
        round(greatest(0, least(x.t1, y.t1) - greatest(x.t0, y.t0)) / 2000, 6) AS span_overlap, round(nn_median, 6) AS nn_median, round(nn_p90, 6) AS nn_p90, round(nn_close_2d, 6) AS nn_close_2d, round(nn_close_10d, 6) AS nn_close_10d
      FROM g AS x JOIN g AS y USING (source, a, b) JOIN nn USING (source, a, b) WHERE x.side = 'a' AND y.side = 'b'""",
    "p16_contrasts": STRETCHED + ", " + features_sql("st", "source, a, b, side") + " SELECT source, a, b, " + ", ".join(
        f"round(x.{c}::DOUBLE, 6) AS a_{c}, round(y.{c}::DOUBLE, 6) AS b_{c}, round(abs(x.{c} - y.{c})::DOUBLE, 6) AS diff_abs_{c}, round((y.{c} - x.{c})::DOUBLE, 6) AS diff_signed_{c}, round(ln((abs(y.{c}) + 1e-3) / (abs(x.{c}) + 1e-3)), 6) AS ratio_log_{c}" for c in CONTRASTED
    ) + " FROM ft AS x JOIN ft AS y USING (source, a, b) WHERE x.side = 'a' AND y.side = 'b'",
    "j11_nearest_time": SIDES + ", " + NEAREST.format("sd") + " SELECT source, a, b, round(nn_median, 6) AS nn_median, round(nn_p90, 6) AS nn_p90, round(nn_close_2d, 6) AS nn_close_2d, round(nn_close_10d, 6) AS nn_close_10d FROM nn",
    "p11_delay_correlations": CORRELATIONS + " SELECT source, a, b, delay, n, round(corr, 7) AS corr, round(mae, 7) AS mae FROM cr",
    "a17_profile_summary": CORRELATIONS + """, tp AS (SELECT source, a, b, max(corr) AS top, arg_max(delay, corr) AS top_delay, arg_min(corr, abs(delay)) AS at_zero, avg(corr) AS mean, stddev_pop(corr) AS std, quantile_cont(corr, 0.95) AS p95, avg((corr > 0.3)::INT) AS over_03, avg((corr > 0.5)::INT) AS over_05, list_reverse_sort(list(corr)) AS tops FROM cr GROUP BY ALL)
      SELECT source, a, b, round(top, 7) AS top, round(top_delay, 7) AS top_delay, round(abs(top_delay), 7) AS top_delay_abs, round(at_zero, 7) AS at_zero, round(mean, 7) AS mean, round(std, 7) AS std, round(p95, 7) AS p95, round(over_03, 7) AS over_03, round(over_05, 7) AS over_05, round(tops[1] - list_avg(tops[2:6]), 7) AS stands_out FROM tp""",
    "a12_duplicate_epochs": f"WITH {LC} SELECT source, component, round(t, 8) AS t, round(sum(y / (s * s)) / sum(1 / (s * s)), 8) AS y, round(sqrt(1 / sum(1 / (s * s))), 8) AS s FROM lc GROUP BY source, component, t",
    "a11_weighted_mean": f"WITH {LC} SELECT source, component, round(sum(y / (s * s)) / sum(1 / (s * s)), 8) AS mean FROM lc GROUP BY ALL",
    "a18_sample_summary": f"WITH {LC}, q AS (SELECT source, component, count(y) AS n_valid, avg(y) AS mean, coalesce(stddev_samp(y), 0) AS std, quantile_cont(y, [0.025, 0.16, 0.5, 0.84, 0.975]) AS q FROM lc GROUP BY ALL) SELECT source, component, n_valid, round(mean, 9) AS mean, round(std, 9) AS std, round(q[3], 9) AS median, round(q[2], 9) AS q16, round(q[4], 9) AS q84, round(q[3] - q[2], 9) AS err_minus, round(q[4] - q[3], 9) AS err_plus, round(q[1], 9) AS q025, round(q[5], 9) AS q975 FROM q",
    "d1_prepared_pairs": PREPARED + " SELECT source, a, b, side, round(t, 7) AS t, round(y, 7) AS y, round(s, 7) AS s FROM p",
    "d5_delay_scores": SCORES + " SELECT source, a, b, delay, n_a, n_b, " + all_rounded("frac_a frac_b span_frac raw_on_interp interp_on_raw interp_on_interp combined", 6) + " FROM s",
    "d7_grid_argmin": SCORES + ", lg AS (UNPIVOT (SELECT source, a, b, delay, raw_on_interp, interp_on_raw, interp_on_interp, combined FROM s) ON raw_on_interp, interp_on_raw, interp_on_interp, combined INTO NAME method VALUE score) SELECT source, a, b, method, round(arg_min(delay, score), 6) AS delay, round(min(score), 6) AS score FROM lg GROUP BY ALL",
}
