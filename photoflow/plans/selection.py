"""Queries of the small operators: selections, scales, ranks, calendar, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classification as K
from ..operators import display as V
from ..operators import events as N
from ..operators import pairs as P
from ..operators import sampling as G
from ..operators import spline_delay as S
from ..operators import spread as W
from ..operators.cleaning import binned, signal_to_noise
from ..sources.curves import KEYS, line_items
from .cleaning import BINS, LC, rounded


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(line_items(spark, sf_dir)).select(*KEYS, "bin", "t", "y", "s")


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.robust_scales(line_items(spark, sf_dir), KEYS, "y"), 11)


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves(spark, sf_dir).groupBy(*KEYS).agg(P.guarded_corr("t", "y").alias("corr")))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_items(spark, sf_dir).groupBy(*KEYS).agg(P.guarded_moment("y", F.skewness("y")).alias("skew"), P.guarded_moment("y", F.kurtosis("y")).alias("kurtosis"))
    return rounded(found)


def top_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.top_means(line_items(spark, sf_dir), KEYS, "y"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal_to_noise(line_items(spark, sf_dir)).select(*KEYS, F.col("snr").alias("score")))


def likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.most_likely(scored(spark, sf_dir), KEYS)


def some_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_pairs(P.component_pairs(line_items(spark, sf_dir)), 50)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.component_groups(line_items(spark, sf_dir))
    return found.select("source", F.array_join("members", ",").alias("members"), F.size("members").alias("n"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_items(spark, sf_dir)
    found = P.looked_up(rows, P.component_groups(rows)).groupBy("source", "place", "component").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    return rounded(found, 6)


def grid_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves(spark, sf_dir)
    times = rows.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).withColumn("t", F.lit(2449720.1370619) + F.col("i") * 50)
    return rounded(P.at_times(rows, times).select(*KEYS, "t", "y").where("y is not null"), 7)


def with_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir).where("score > 2").withColumn("component", F.concat_ws("-", *KEYS)).withColumn("positive", F.col("score") > 2.2)
    every = line_items(spark, sf_dir).select(F.concat_ws("-", *KEYS).alias("component")).distinct()
    return K.with_predictions(every, found)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.prepared(line_items(spark, sf_dir), more_than=20), 7)


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.select(F.col("l_returnflag").alias("component"), F.col("l_suppkey").cast("string").alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return K.first_source(rows, "file", "row")


def scatter(spark: SparkSession, sf_dir: str, by_time: bool) -> DataFrame:
    found = S.rolling_scatter(curves(spark, sf_dir), KEYS, S.Search(window=5 if by_time else 3, by_time=by_time))
    return found.select(*KEYS, F.round("t", 7).alias("t"), F.round("scatter", 11).alias("scatter"))


def scatter_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scatter(spark, sf_dir, True)


def scatter_by_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scatter(spark, sf_dir, False)


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.gradients(curves(spark, sf_dir)), 9)


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ranked_groups(line_items(spark, sf_dir)).select(*KEYS, "rank")


def first_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.first_points(line_items(spark, sf_dir), 100).groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum("y").alias("total")), 6)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', day)")
    days = items.groupBy(F.col("l_suppkey").alias("source")).agg(F.min("l_shipdate").alias("day"))
    return rounded(days.select("source", *G.calendar(seconds)), 6)


def samplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = line_items(spark, sf_dir).withColumn("day", F.floor("t").cast("long"))
    return G.distinct_samplings(days, KEYS, "day")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = line_items(spark, sf_dir).groupBy(*KEYS).agg(F.min("y").alias("low"), F.max("y").alias("high"))
    named = ends.select(*KEYS, V.even_steps(F.col("low"), F.col("high"), 5).alias("even"), V.even_steps(F.col("low"), F.col("high"), 5, True).alias("by_factor"))
    rows = named.select(*KEYS, F.posexplode(F.arrays_zip("even", "by_factor")).alias("i", "e"))
    return rounded(rows.select(*KEYS, "i", "e.even", "e.by_factor"), 7)


def some_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.shown(line_items(spark, sf_dir), components=["A", "N"]).groupBy(*KEYS).agg(F.count("*").alias("n"))


def in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within_days(line_items(spark, sf_dir), 2450000.0, 2451000.0).groupBy(*KEYS).agg(F.count("*").alias("n"))


def dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return G.kept_by_chance(items, 0.2, 7, "l_orderkey", "l_linenumber").groupBy(F.col("l_returnflag").alias("component")).agg(F.count("*").alias("n"))


def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.predicted(scored(spark, sf_dir), 2.2)
    return K.renamed_for("real", found, KEYS)


def plain_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.without_scores(K.predicted(scored(spark, sf_dir), 2.2))


def by_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.globally_normalised(line_items(spark, sf_dir), 38.0, 22.5).groupBy(*KEYS).agg(F.avg("y").alias("mean"), F.max("y").alias("most")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.series(line_items(spark, sf_dir))
    return rounded(found.select(*KEYS, F.size("values").alias("n"), F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last")))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.series(line_items(spark, sf_dir).withColumn("y", F.col("y") / 7.3)).withColumn("mask", F.transform("values", lambda v: v > 3))
    return rounded(K.masked_stats(rows, "values", "mask").select(*KEYS, "masked_mean", "masked_std"), 9)


def julian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_items(spark, sf_dir).withColumn("t", F.col("t") - 2400000.5)
    return rounded(G.julian_from_any(rows, "t").groupBy(*KEYS).agg(F.min("t").alias("first")), 6)


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.noise_level(line_items(spark, sf_dir), KEYS, 0.02))


def on_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: places on the sky of shares that a curve's points give, moved by some arc seconds."""
    shares = line_items(spark, sf_dir).groupBy(*KEYS).agg((F.avg("y") / F.max("y")).alias("u"), (F.min("s") / F.avg("s")).alias("v"), F.count("*").alias("n"))
    ra, dec = G.sky_position(F.col("u"), F.col("v"))
    moved = G.moved_on_sky(F.col("ra"), F.col("dec"), F.col("n") / 10, F.col("n").cast("double"))
    return rounded(shares.select(*KEYS, "n", ra.alias("ra"), dec.alias("dec")).select(*KEYS, "ra", "dec", moved[0].alias("moved_ra"), moved[1].alias("moved_dec")), 9)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13: fluxes whose error is large are gaps, filled from their neighbours."""
    rows = line_items(spark, sf_dir).withColumn("y", F.when(F.col("s") < 20, F.col("y")))
    found = W.gaps_filled(rows, KEYS, ("t", "s"), "y")
    return found.select(*KEYS, F.round("t", 7).alias("t"), F.round("y", 10).alias("y"), F.round("s", 9).alias("s"))


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.gaps(line_items(spark, sf_dir), KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.median("gap").alias("median"), F.max("gap").alias("most"))
    return rounded(found)


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram(line_items(spark, sf_dir), KEYS, "y", 10.0, 90.0, 20)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.group_titles(line_items(spark, sf_dir))


def smooth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a Gaussian process through each curve."""
    return rounded(V.gaussian_process(curves(spark, sf_dir)), 6)


def event_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the last 128 events of each curve as the single-curve network reads them."""
    return rounded(N.event_rows(curves(spark, sf_dir)), 7)


def u_sql(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws('/', {joined})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


QUERIES = {
    "a10_robust_scales": scales,
    "a14_guarded_corr": guarded,
    "a15_guarded_moments": moments,
    "t6_top_means": top_means,
    "t7_most_likely": likely,
    "t8_first_pairs": some_pairs,
    "id_component_groups": groups,
    "f7_looked_up": lookup,
    "j9_interp_grid": grid_flux,
    "j3_left_or": with_predictions,
    "a3_prepared": prepared,
    "a4_first_source": origins,
    "w4_scatter_by_time": scatter_by_time,
    "w3_scatter_by_points": scatter_by_points,
    "w6_gradients": gradients,
    "w9_group_ranks": ranks,
    "w12_first_points": first_points,
    "x5_calendar": calendar,
    "x7_samplings": samplings,
    "x8_even_steps": steps,
    "f9_shown": some_components,
    "f11_within_days": in_range,
    "f12_dropout": dropout,
    "f14_renamed": domain,
    "f15_without_scores": plain_predictions,
    "m1_globally_normalised": by_training_set,
    "m2_series": panel,
    "a23_masked_stats": masked,
    "s12_julian_from_any": julian,
    "g5_noise_level": noise,
    "x11_sky_positions": on_sky,
    "d13_gaps_filled": filled,
    "g11_cadence": cadence,
    "v4_histogram": histogram,
    "x6_group_titles": titles,
    "v2_gaussian_process": smooth_lines,
    "m6_event_tensor": event_tensor,
}
_SNR = "(quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2 / median(s)"
_MERGED = f"""RECURSIVE {LC}, big AS (SELECT source, component FROM lc GROUP BY ALL HAVING count(*) > 20), o AS (SELECT lc.*, row_number() OVER (PARTITION BY source, component ORDER BY t, y, s) AS i FROM lc SEMI JOIN big USING (source, component)),
      r AS (SELECT source, component, i, t, y, t AS start, 1 AS block FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.component, o.i, o.t, o.y, CASE WHEN o.t - r.start <= 2 THEN r.start ELSE o.t END, CASE WHEN o.t - r.start <= 2 THEN r.block ELSE r.block + 1 END FROM r JOIN o ON o.source = r.source AND o.component = r.component AND o.i = r.i + 1),
      w AS (SELECT source, component, avg(t) AS t, sum(y) / count(*) AS y, count(*) AS n FROM r GROUP BY source, component, block)"""
_NEAR = """o AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY t, y) AS i, t - lag(t) OVER (PARTITION BY source, component ORDER BY t, y) AS gap FROM b),
      g AS (SELECT source, component, 2.5 * median(gap) FILTER (gap > 0) AS radius FROM o GROUP BY ALL)"""
_GRADIENT = """coalesce((h0 * h0 * v1 + (h1 * h1 - h0 * h0) * v - h1 * h1 * v0) / (h0 * h1 * (h1 + h0)), (v1 - v) / h1, (v - v0) / h0, 0)"""
ORACLE_SQL = {
    "a10_robust_scales": f"""WITH {LC}, m AS (SELECT source, component, median(y) AS middle, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, stddev_pop(y) AS std FROM lc GROUP BY ALL),
      d AS (SELECT source, component, 1.4826 * median(abs(y - middle)) AS mad FROM lc JOIN m USING (source, component) GROUP BY ALL)
      SELECT source, component, round(middle, 11) AS middle, round(CASE WHEN mad >= 1e-6 THEN mad WHEN iqr / 1.349 >= 1e-6 THEN iqr / 1.349 WHEN std >= 1e-6 THEN std ELSE 1 END, 11) AS scale FROM m JOIN d USING (source, component)""",
    "a14_guarded_corr": f"WITH {BINS} SELECT source, component, round(CASE WHEN count(*) < 3 OR stddev_pop(t) < 1e-8 OR stddev_pop(y) < 1e-8 THEN 0 ELSE corr(t, y) END, 8) AS corr FROM b GROUP BY source, component",
    "a15_guarded_moments": f"WITH {LC}, m AS (SELECT *, y - avg(y) OVER w AS d FROM lc WINDOW w AS (PARTITION BY source, component)) SELECT source, component, round(avg(d ** 3) / stddev_pop(y) ** 3, 8) AS skew, round(avg(d ** 4) / stddev_pop(y) ** 4 - 3, 8) AS kurtosis FROM m GROUP BY source, component",
    "t6_top_means": f"WITH {LC}, r AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY y DESC) AS i FROM lc) SELECT source, component, round(avg(y) FILTER (i <= 3), 8) AS top3_mean, round(avg(y) FILTER (i <= 5), 8) AS top5_mean FROM r GROUP BY source, component",
    "t7_most_likely": f"WITH {LC} SELECT source, component, round({_SNR}, 8) AS score FROM lc GROUP BY source, component ORDER BY score DESC, source, component LIMIT 20",
    "t8_first_pairs": f"WITH {LC}, u AS (SELECT DISTINCT source, component FROM lc) SELECT x.source, x.component AS a, y.component AS b FROM u AS x JOIN u AS y ON x.source = y.source AND x.component < y.component ORDER BY ALL LIMIT 50",
    "id_component_groups": f"WITH {LC} SELECT source, string_agg(DISTINCT component, ',' ORDER BY component) AS members, count(DISTINCT component)::INTEGER AS n FROM lc GROUP BY source HAVING count(DISTINCT component) BETWEEN 2 AND 4",
    "f7_looked_up": f"WITH {LC}, r AS (SELECT *, (dense_rank() OVER (PARTITION BY source ORDER BY component) - 1)::INTEGER AS place FROM lc) SELECT source, place, component, count(*) AS n, round(sum(y), 6) AS total FROM r WHERE s > 0 GROUP BY ALL",
    "j9_interp_grid": f"""WITH {BINS}, q AS (SELECT source, component, 2449720.1370619::DOUBLE + 50 * i AS t FROM (SELECT DISTINCT source, component FROM b), range(50) AS r(i)),
      q0 AS (SELECT q.*, b.t AS t0, b.y AS y0 FROM q ASOF JOIN b ON q.source = b.source AND q.component = b.component AND q.t >= b.t), q1 AS (SELECT q0.*, b.t AS t1, b.y AS y1 FROM q0 ASOF JOIN b ON q0.source = b.source AND q0.component = b.component AND q0.t <= b.t)
      SELECT source, component, round(t, 7) AS t, round(CASE WHEN t1 > t0 THEN y0 * (1 - (t - t0) / (t1 - t0)) + y1 * ((t - t0) / (t1 - t0)) ELSE y0 END, 7) AS y FROM q1""",
    "j3_left_or": f"WITH {LC}, m AS (SELECT source || '-' || component AS component, round({_SNR}, 8) AS score FROM lc GROUP BY lc.source, lc.component) SELECT component, coalesce(score > 2 AND score > 2.2, false) AS positive FROM m",
    "a3_prepared": f"WITH {_MERGED} SELECT source, component, round(t, 7) AS t, round(y, 7) AS y, n FROM w SEMI JOIN (SELECT source, component FROM w GROUP BY ALL HAVING count(*) > 20) USING (source, component)",
    "a4_first_source": "SELECT l_returnflag AS component, arg_min(l_suppkey::VARCHAR, i) AS source FROM (SELECT *, row_number() OVER () AS i FROM lineitem) GROUP BY ALL",
    "w4_scatter_by_time": f"""WITH {BINS}, {_NEAR}, c AS (SELECT o.source, o.component, o.i, count(*) AS held FROM o JOIN g USING (source, component) JOIN o AS n ON n.source = o.source AND n.component = o.component AND n.t BETWEEN o.t - radius AND o.t + radius GROUP BY ALL),
      x AS (SELECT o.source, o.component, o.i, o.t, n.y FROM o JOIN g USING (source, component) JOIN c USING (source, component, i) JOIN o AS n ON n.source = o.source AND n.component = o.component AND CASE WHEN held >= 5 THEN n.t BETWEEN o.t - radius AND o.t + radius ELSE n.i BETWEEN o.i - 2 AND o.i + 2 END),
      m AS (SELECT source, component, i, median(y) AS mid FROM x GROUP BY ALL) SELECT source, component, round(any_value(t), 7) AS t, round(greatest(1.4826 * median(abs(y - mid)), 0.05), 11) AS scatter FROM x JOIN m USING (source, component, i) GROUP BY source, component, i""",
    "w3_scatter_by_points": f"""WITH {BINS}, {_NEAR}, x AS (SELECT o.source, o.component, o.i, o.t, n.y FROM o JOIN o AS n ON n.source = o.source AND n.component = o.component AND n.i BETWEEN o.i - 2 AND o.i + 2),
      m AS (SELECT source, component, i, median(y) AS mid FROM x GROUP BY ALL) SELECT source, component, round(any_value(t), 7) AS t, round(greatest(1.4826 * median(abs(y - mid)), 0.05), 11) AS scatter FROM x JOIN m USING (source, component, i) GROUP BY source, component, i""",
    "w6_gradients": f"""WITH {BINS}, k AS (SELECT source, component, median(y) AS mid, stddev_pop(y) AS std FROM b GROUP BY ALL), k2 AS (SELECT source, component, 1.4826 * median(abs(y - mid)) AS mad, any_value(std) AS std, any_value(mid) AS mid FROM b JOIN k USING (source, component) GROUP BY ALL),
      z AS (SELECT source, component, t, y, (y - mid) / CASE WHEN mad > 1e-6 THEN mad WHEN std > 1e-6 THEN std ELSE 1 END AS z FROM b JOIN k2 USING (source, component)),
      n AS (SELECT *, z AS v, lag(z) OVER w AS v0, lead(z) OVER w AS v1, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1 FROM z WINDOW w AS (PARTITION BY source, component ORDER BY t, y)), d AS (SELECT *, {_GRADIENT} AS d1 FROM n),
      n2 AS (SELECT * EXCLUDE (v, v0, v1), d1 AS v, lag(d1) OVER w AS v0, lead(d1) OVER w AS v1 FROM d WINDOW w AS (PARTITION BY source, component ORDER BY t, y))
      SELECT source, component, round(t, 9) AS t, round(z, 9) AS z, round(tanh(d1 / 8), 9) AS d1, round(tanh({_GRADIENT} / 8), 9) AS d2 FROM n2""",
    "w9_group_ranks": f"WITH {LC}, f AS (SELECT source, component, min(t) AS first FROM lc GROUP BY ALL) SELECT source, component, row_number() OVER (ORDER BY first, source, component)::INTEGER AS rank FROM f",
    "w12_first_points": f"WITH {LC}, r AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY t, y, s) AS i FROM lc) SELECT source, component, count(*) AS n, round(max(t), 6) AS last, round(sum(y), 6) AS total FROM r WHERE i <= 100 GROUP BY source, component",
    "x5_calendar": "WITH d AS (SELECT l_suppkey AS source, epoch(min(l_shipdate)) / 86400.0 + 2440587.5 AS jd FROM lineitem GROUP BY ALL) SELECT source, round(jd, 6) AS jd, round(jd - 2400000.5, 6) AS mjd, round(2000 + (jd - 2451545.0) / 365.25, 6) AS jyear FROM d",
    "x7_samplings": f"WITH {LC}, g AS (SELECT source, component, substr(sha1(string_agg(floor(t)::BIGINT::VARCHAR, ',' ORDER BY floor(t)::BIGINT)), 1, 16) AS signature FROM lc GROUP BY source, component) SELECT min((source, component))[1] AS source, min((source, component))[2] AS component, signature, count(*) AS copies FROM g GROUP BY signature",
    "x8_even_steps": f"WITH {LC}, e AS (SELECT source, component, min(y) AS low, max(y) AS high FROM lc GROUP BY ALL) SELECT source, component, i::INTEGER AS i, round(low + (high - low) * (i / 4.0::DOUBLE), 7) AS even, round(low * pow(high / low, i / 4.0::DOUBLE), 7) AS by_factor FROM e, range(5) AS r(i)",
    "f9_shown": f"WITH {LC} SELECT source, component, count(*) AS n FROM lc WHERE component IN ('A', 'N') GROUP BY ALL",
    "f11_within_days": f"WITH {LC} SELECT source, component, count(*) AS n FROM lc WHERE t BETWEEN 2450000 AND 2451000 GROUP BY ALL",
    "f12_dropout": f"SELECT l_returnflag AS component, count(*) AS n FROM lineitem WHERE {u_sql("'7'", 'l_orderkey::VARCHAR', 'l_linenumber::VARCHAR')} >= 0.2 GROUP BY ALL",
    "f14_renamed": f"WITH {LC}, m AS (SELECT source, component, round({_SNR}, 8) AS score FROM lc GROUP BY ALL) SELECT source, component, score AS score_real, score >= 2.2 AS predicted_real FROM m",
    "f15_without_scores": f"WITH {LC}, m AS (SELECT source, component, round({_SNR}, 8) AS score FROM lc GROUP BY ALL) SELECT source, component, score >= 2.2 AS predicted FROM m",
    "m1_globally_normalised": f"WITH {LC} SELECT source, component, round(avg((y - 38) / 22.5), 8) AS mean, round(max((y - 38) / 22.5), 8) AS most FROM lc GROUP BY ALL",
    "m2_series": f"WITH {LC} SELECT source, component, count(*)::INTEGER AS n, round(arg_min(y, (t, y, s)), 8) AS first, round(arg_max(y, (t, y, s)), 8) AS last FROM lc GROUP BY ALL",
    "a23_masked_stats": f"WITH {LC} SELECT source, component, round(avg(y / 7.3::DOUBLE) FILTER (y / 7.3::DOUBLE > 3), 9) AS masked_mean, round(stddev_pop(y / 7.3::DOUBLE) FILTER (y / 7.3::DOUBLE > 3), 9) AS masked_std FROM lc GROUP BY ALL",
    "s12_julian_from_any": f"WITH {LC} SELECT source, component, round(min(t), 6) AS first FROM lc GROUP BY ALL",
    "g5_noise_level": f"WITH {LC} SELECT source, component, round(0.02 * median(abs(y)), 8) AS noise FROM lc GROUP BY ALL",
    "x11_sky_positions": f"""WITH {LC}, p AS (SELECT source, component, avg(y) / max(y) * 360 AS ra, degrees(asin(min(s) / avg(s) * 2 - 1)) AS dec, count(*) AS n FROM lc GROUP BY ALL)
      SELECT source, component, round(ra, 9) AS ra, round(dec, 9) AS dec, round((ra + n / 36000 * sin(radians(n)) / greatest(abs(cos(radians(dec))), 1e-6) + 360) % 360, 9) AS moved_ra, round(greatest(-90, least(90, dec + n / 36000 * cos(radians(n)))), 9) AS moved_dec FROM p""",
    "d13_gaps_filled": f"""WITH {LC}, o AS (SELECT *, row_number() OVER w AS i, CASE WHEN s < 20 THEN y END AS v FROM lc WINDOW w AS (PARTITION BY source, component ORDER BY t, s)),
      k AS (SELECT source, component, i, v FROM o WHERE v IS NOT NULL), a AS (SELECT o.*, k.i AS ia, k.v AS va FROM o ASOF LEFT JOIN k ON o.source = k.source AND o.component = k.component AND o.i >= k.i),
      b AS (SELECT a.*, k.i AS ib, k.v AS vb FROM a ASOF LEFT JOIN k ON a.source = k.source AND a.component = k.component AND a.i <= k.i)
      SELECT source, component, round(t, 7) AS t, round(CASE WHEN va IS NULL AND vb IS NULL THEN 0 WHEN va IS NULL THEN vb WHEN vb IS NULL OR ia = ib THEN va ELSE va + (vb - va) * ((i - ia) / (ib - ia)) END, 10) AS y, round(s, 9) AS s FROM b""",
    "g11_cadence": f"WITH {LC}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY source, component ORDER BY t, y, s) AS gap FROM lc) SELECT source, component, count(*) AS n, round(avg(gap), 8) AS mean, round(median(gap), 8) AS median, round(max(gap), 8) AS most FROM g GROUP BY source, component",
    "v4_histogram": f"WITH {LC} SELECT source, component, CASE WHEN y < 10 THEN 0 WHEN y >= 90 THEN 21 ELSE floor((y - 10) / 80 * 20)::BIGINT + 1 END AS bucket, count(*) AS n FROM lc GROUP BY ALL",
    "m6_event_tensor": f"""WITH {BINS}, n AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY t DESC, y DESC) AS back FROM b), l AS (SELECT source, component, t, y FROM n WHERE back <= 128),
      k AS (SELECT source, component, median(y) AS mid, stddev_pop(y) AS std FROM l GROUP BY ALL), k2 AS (SELECT source, component, 1.4826 * median(abs(y - mid)) AS mad, any_value(std) AS std, any_value(mid) AS mid FROM l JOIN k USING (source, component) GROUP BY ALL),
      z AS (SELECT l.*, (y - mid) / CASE WHEN mad > 1e-6 THEN mad WHEN std > 1e-6 THEN std ELSE 1 END AS z FROM l JOIN k2 USING (source, component)),
      g AS (SELECT *, row_number() OVER w AS i, ln(1 + coalesce(t - lag(t) OVER w, 0)) AS lg, coalesce((z - lag(z) OVER w) / greatest(t - lag(t) OVER w, 1e-3), 0) AS sl, (t - min(t) OVER v) / (max(t) OVER v - min(t) OVER v) AS rel FROM z WINDOW w AS (PARTITION BY source, component ORDER BY t, y), v AS (PARTITION BY source, component)),
      q AS (SELECT source, component, median(lg) AS mid, stddev_pop(lg) AS std FROM g GROUP BY ALL), q2 AS (SELECT source, component, 1.4826 * median(abs(lg - mid)) AS mad, any_value(mid) AS mid, any_value(std) AS std FROM g JOIN q USING (source, component) GROUP BY ALL)
      SELECT source, component, i::INTEGER AS i, round(z, 7) AS z, round((lg - mid) / CASE WHEN mad > 1e-6 THEN mad WHEN std > 1e-6 THEN std ELSE 1 END, 7) AS log_gap, round(rel, 7) AS relative_t, round(greatest(-20, least(20, sl)), 7) AS slope, round(abs(greatest(-20, least(20, sl))), 7) AS slope_size FROM g JOIN q2 USING (source, component)""",
    "x6_group_titles": f"WITH {LC} SELECT DISTINCT source, component, 'source=' || source || ', component=' || component AS title FROM lc",
}
