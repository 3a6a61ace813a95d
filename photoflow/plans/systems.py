"""Queries over systems of two to four curves, forest features and their scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut
from ..operators import classification as K
from ..operators import packing as G
from ..operators import pair_scan as Q
from ..operators import pairs as P
from ..operators import spline_delay as S
from ..sources.curves import KEYS, line_items
from .cleaning import LC, rounded
from .pairs import BINS, curves, sides

#: Draws of the registered Monte Carlo query; ``drawn_delays`` takes 200 unless told otherwise.
DRAWS = 3
#: Delay vectors at which overlaps are checked by SQL.
VECTORS = [[0.0, 0.0, 0.0], [0.0, 30.0, -30.0], [0.0, -700.0, 1500.0]]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.component_groups(curves(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalised(curves(spark, sf_dir), members(spark, sf_dir))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points(spark, sf_dir).select("source", "place", "component", "t", "y", "s"), 7)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.balance_weights(points(spark, sf_dir)).select("source", "place", "t", "w"), 7)


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*[F.array(*[F.lit(d) for d in v]) for v in VECTORS])
    rows = points(spark, sf_dir)
    found = S.overlaps(rows, members(spark, sf_dir).withColumn("delays", F.explode(asked)))
    return rounded(found.select("source", F.get("delays", F.lit(1)).alias("delay_b"), F.get("delays", F.lit(2)).alias("delay_c"), "start", "end", "span_frac", "least_n", "least_frac", "enough"), 7)


def knot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.knot_bounds(points(spark, sf_dir)).select("source", "n_times", "most_knots")


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.quantile_knots(points(spark, sf_dir), 15)
    return rounded(found.select("source", F.posexplode("knots").alias("i", "knot")), 7)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delay vector of each source and year: how much later each component's
    flux is centred than that of its first one."""
    rows = line_items(spark, sf_dir).withColumn("draw", F.floor((F.col("t") - 2449717.5) / 365.25))
    found = rows.groupBy("source", "draw", "component").agg((F.sum(F.col("t") * F.col("y")) / F.sum("y")).alias("at"))
    found = found.groupBy("source", "draw").agg(F.array_sort(F.collect_list(F.struct("component", "at")))["at"].alias("at")).where(F.size("at") == 3)
    return found.select("source", "draw", F.transform("at", lambda t: t - F.get("at", F.lit(0))).alias("delays"))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.delay_differences(centroids(spark, sf_dir), ["source", "draw"]), 6)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19: quantiles over draws of each pair of places."""
    return rounded(P.sample_summary(S.delay_differences(centroids(spark, sf_dir), ["source", "draw"]), ["source", "i", "j"], "delay"), 6)


def found_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spline_delays(curves(spark, sf_dir), members(spark, sf_dir), S.QUICK)


def spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_delays(spark, sf_dir)
    return rounded(found.select("source", F.array_join(F.transform("delays", lambda d: F.round(d, 4).cast("string")), ",").alias("delays"), "cost", "loo", "bic", "n_knots", "freedom", "span_frac", "least_frac", "n_overlap", "reason"), 5)


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_delays(spark, sf_dir).where("delays is not null")
    return rounded(S.delay_differences(found, ["source"]), 4)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.drawn_delays(curves(spark, sf_dir), members(spark, sf_dir), S.QUICK, DRAWS)
    return rounded(P.sample_summary(S.delay_differences(found, ["source", "draw"]), ["source", "i", "j"], "delay"), 4)


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.quadratic_trends(curves(spark, sf_dir).withColumn("t", F.col("t") - 2449000.0), KEYS), 6)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.shape_features(curves(spark, sf_dir), KEYS), 7)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.scan(P.stretched(sides(spark, sf_dir))), 7)


def scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.scanned_features(P.stretched(sides(spark, sf_dir))), 7)


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17: all 570 features of each pair, of packed curves."""
    return G.pair_features(P.stretched(sides(spark, sf_dir)))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pair_features(spark, sf_dir), 5)


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18: a forest over all features tells pairs of components A and R from
    others, which no feature names. It learns from sources of one fold and
    scores the pairs of both; a pair without features has a null score."""
    found = cut(pair_features(spark, sf_dir))
    names = [c for c in found.columns if c not in P.PAIR]
    held_out = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(3)) == 0
    label = ((F.col("a") == "A") & (F.col("b") == "R")).cast("double")
    model = K.trained_forest(found.where(~held_out).withColumn("label", label), "label", names, trees=100)
    every = P.component_pairs(line_items(spark, sf_dir))
    return rounded(K.forest_scores(model, found, names, every, P.PAIR).withColumn("held_out", held_out), 6)


_D10 = BINS + """, u AS (SELECT source, list_sort(list(DISTINCT component)) AS members FROM b GROUP BY source), sy AS (SELECT source, component, (list_position(members, component) - 1)::INTEGER AS place, len(members) AS k FROM u, unnest(members) AS x(component) WHERE len(members) BETWEEN 2 AND 4),
r0 AS (SELECT b.source, place, component, k, t, y, s FROM b JOIN sy USING (source, component)), m1 AS (SELECT source, place, median(y) AS mid, stddev_pop(y) AS std FROM r0 GROUP BY ALL), m2 AS (SELECT source, place, 1.4826 * median(abs(y - mid)) AS mad, any_value(mid) AS mid, any_value(std) AS std FROM r0 JOIN m1 USING (source, place) GROUP BY ALL),
m3 AS (SELECT source, place, mid, CASE WHEN mad > 1e-12 THEN mad WHEN std > 1e-12 THEN std ELSE 1 END AS scale FROM m2),
p AS (SELECT r0.source, r0.place, component, k, t - min(t) OVER (PARTITION BY r0.source) AS t, (y - mid) / scale AS y, greatest(s / scale, 0.05) AS s FROM r0 JOIN m3 USING (source, place))"""
_CENTROIDS = LC + """, c AS (SELECT source, floor((t - 2449717.5) / 365.25)::BIGINT AS draw, component, sum(t * y) / sum(y) AS at FROM lc GROUP BY ALL), r AS (SELECT *, (row_number() OVER w - 1)::INTEGER AS place, count(*) OVER v AS k FROM c WINDOW w AS (PARTITION BY source, draw ORDER BY component), v AS (PARTITION BY source, draw)),
dd AS (SELECT x.source, x.draw, x.place AS i, y.place AS j, (y.at - z.at) - (x.at - z.at) AS delay FROM r AS x JOIN r AS y ON x.source = y.source AND x.draw = y.draw AND x.place < y.place JOIN r AS z ON z.source = x.source AND z.draw = x.draw AND z.place = 0 WHERE x.k = 3)"""
QUERIES = {
    "d10_normalised_systems": normalised,
    "d11_shared_overlaps": overlaps,
    "a20_balance_weights": weights,
    "a24_knot_bounds": knot_bounds,
    "d15_quantile_knots": knots,
    "j14_delay_differences": differences,
    "a19_delay_summaries": summaries,
    "d23_pspline": spline,
    "d25_pair_delays": pair_table,
    "d26_mc": drawn,
    "p5_quadratic_trends": trends,
    "p8_shape_features": shapes,
    "p12_p14_scan": scan,
    "p14_scan_features": scan_features,
    "p17_pair_features": assembled,
    "p18_forest_scores": forest,
}
ORACLE_SQL = {
    "d10_normalised_systems": f"WITH {_D10} SELECT source, place, component, round(t, 7) AS t, round(y, 7) AS y, round(s, 7) AS s FROM p",
    "a20_balance_weights": f"WITH {_D10}, w AS (SELECT *, 1 / greatest(s * s, 1e-12) AS w FROM p) SELECT source, place, round(t, 7) AS t, round(w * count(*) OVER (PARTITION BY source) / k / sum(w) OVER (PARTITION BY source, place), 7) AS w FROM w",
    "a24_knot_bounds": f"WITH {_D10} SELECT source, count(DISTINCT t) AS n_times, greatest(0, count(DISTINCT t) - 6) AS most_knots FROM p GROUP BY source",
    "d15_quantile_knots": f"WITH {_D10}, q AS (SELECT source, i::INTEGER AS i, quantile_cont(t, [1/16, 2/16, 3/16, 4/16, 5/16, 6/16, 7/16, 8/16, 9/16, 10/16, 11/16, 12/16, 13/16, 14/16, 15/16])[i + 1] AS knot FROM p, range(15) AS r(i) GROUP BY source, i) SELECT source, i, round(knot, 7) AS knot FROM q",
    "d11_shared_overlaps": f"""WITH {_D10}, v AS (FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (30.0, -30.0), (-700.0, 1500.0)) AS x(d1, d2)), mv AS (SELECT p.*, d1, d2, t - CASE place WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE 0 END AS m FROM p, v),
      e AS (SELECT source, d1, d2, place, min(m) AS t0, max(m) AS t1 FROM mv GROUP BY ALL), sp AS (SELECT source, d1, d2, max(t0) AS st, min(t1) AS en, min(t1 - t0) AS sh FROM e GROUP BY ALL),
      i AS (SELECT source, d1, d2, place, st, en, sh, count(*) FILTER (m BETWEEN st AND en) AS n, count(*) AS a FROM mv JOIN sp USING (source, d1, d2) GROUP BY ALL),
      f AS (SELECT source, d1, d2, any_value(st) AS st, any_value(en) AS en, (any_value(en) - any_value(st)) / greatest(any_value(sh), 1e-12) AS sf, min(n) AS ln, min(n / a) AS lf FROM i GROUP BY ALL)
      SELECT source, d1 AS delay_b, d2 AS delay_c, round(st, 7) AS start, round(en, 7) AS "end", round(sf, 7) AS span_frac, ln AS least_n, round(lf, 7) AS least_frac, en > st AND ln >= 10 AND lf >= 0.5 AND sf >= 0.5 AS enough FROM f""",
    "j14_delay_differences": f"WITH {_CENTROIDS} SELECT source, draw, i, j, round(delay, 6) AS delay FROM dd",
    "a19_delay_summaries": f"""WITH {_CENTROIDS}, q AS (SELECT source, i, j, count(delay) AS n_valid, avg(delay) AS mean, coalesce(stddev_samp(delay), 0) AS std, quantile_cont(delay, [0.025, 0.16, 0.5, 0.84, 0.975]) AS q FROM dd GROUP BY ALL)
      SELECT source, i, j, n_valid, round(mean, 6) AS mean, round(std, 6) AS std, round(q[3], 6) AS median, round(q[2], 6) AS q16, round(q[4], 6) AS q84, round(q[3] - q[2], 6) AS err_minus, round(q[4] - q[3], 6) AS err_plus, round(q[1], 6) AS q025, round(q[5], 6) AS q975 FROM q""",
    "p5_quadratic_trends": f"""WITH {BINS}, m AS (SELECT source, component, avg(t) AS mid, stddev_pop(t) + 1e-8 AS std FROM b GROUP BY ALL), x AS (SELECT b.source, b.component, (t - mid) / std AS x, y FROM b JOIN m USING (source, component)),
      g AS (SELECT source, component, covar_pop(x, x) AS v11, covar_pop(x, x * x) AS v12, covar_pop(x * x, x * x) AS v22, covar_pop(x, y) AS v1y, covar_pop(x * x, y) AS v2y, var_pop(y) AS vyy FROM x GROUP BY ALL), d AS (SELECT *, (v11 * v2y - v12 * v1y) / (v11 * v22 - v12 * v12) AS quad, (v22 * v1y - v12 * v2y) / (v11 * v22 - v12 * v12) AS slope FROM g)
      SELECT source, component, round(v1y / v11, 6) AS trend_slope, round(quad, 6) AS trend_quad, round(sqrt(vyy - quad * v2y - slope * v1y), 6) AS resid2_std FROM d""",
}
