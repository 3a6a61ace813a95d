"""Queries over single curves: merged windows, channels, fusion, display."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classification as K
from ..operators import display as V
from ..operators.cleaning import binned, signal_to_noise
from ..sources.curves import KEYS, line_items
from .cleaning import BINS, LC, rounded


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.merged_windows(line_items(spark, sf_dir)), 7)


def enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counted(line_items(spark, sf_dir), 200).groupBy(*KEYS).agg(F.count("*").alias("n"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.events(binned(line_items(spark, sf_dir)).select(*KEYS, "t", "y", "s")), 6)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.derivative_channels(binned(line_items(spark, sf_dir)).select(*KEYS, "t", "y", "s")), 6)


def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2: one model takes long curves, the other short ones; those in between have two scores."""
    found = signal_to_noise(line_items(spark, sf_dir)).withColumn("component", F.concat_ws("-", *KEYS)).withColumn("score", F.col("snr"))
    forest = found.where("n >= 190").withColumn("predicted", F.col("snr") > 2.2)
    network = found.where("n <= 210").withColumn("predicted", F.col("n") > 200)
    return rounded(K.fused(forest, network), 6)


def modes(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    curves = binned(line_items(spark, sf_dir)).select(*KEYS, "t", "y", "s")
    return rounded(V.in_mode(curves, mode), 7)


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.smoothed(binned(line_items(spark, sf_dir)), 6).select(*KEYS, "bin", "smooth"), 9)


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.rolling_spread(binned(line_items(spark, sf_dir)).select(*KEYS, "bin", "t", "y", "s")).select(*KEYS, "bin", "rolling_median", "rolling_mad"), 11)


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.weighted_median(line_items(spark, sf_dir).withColumn("w", F.round("s")), KEYS, "y", "w"), 8)


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).groupBy(*KEYS).agg(F.date_format(V.timestamp_of(F.min("t")), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


def component_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: two components over each other, one moved, one scaled and lifted."""
    rows = binned(line_items(spark, sf_dir)).select(*KEYS, "t", "y", "s")
    found = V.component_table(rows, ["A", "N"], "minmax", delays={"N": 12.5}, scales={"A": -2.0}, offsets={"A": 3.0}, window=4)
    return rounded(found.withColumn("at", F.date_format("at", "yyyy-MM-dd")), 7)


_Z = BINS + """, k AS (SELECT source, component, median(y) AS mid, stddev_pop(y) AS std FROM b GROUP BY ALL), k2 AS (SELECT source, component, 1.4826 * median(abs(y - mid)) AS mad, any_value(std) AS std, any_value(mid) AS mid FROM b JOIN k USING (source, component) GROUP BY ALL),
zz AS (SELECT source, component, t, y, s, (y - mid) / CASE WHEN mad > 1e-6 THEN mad WHEN std > 1e-6 THEN std ELSE 1 END AS z FROM b JOIN k2 USING (source, component))"""


def mode_sql(value: str, divisor: str = "1") -> str:
    return f"WITH {BINS} SELECT source, component, round(t, 7) AS t, round({value}, 7) AS y, round(s / ({divisor}), 7) AS s FROM b WINDOW g AS (PARTITION BY source, component), f AS (PARTITION BY source, component ORDER BY t, y, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


_MODES = {
    "raw": mode_sql("y"), "centered": mode_sql("y - avg(y) OVER g"), "normalized": mode_sql("(y - avg(y) OVER g) / stddev_pop(y) OVER g", "stddev_pop(y) OVER g"),
    "minmax": mode_sql("(y - min(y) OVER g) / (max(y) OVER g - min(y) OVER g)", "max(y) OVER g - min(y) OVER g"), "first=0": mode_sql("y - first(y) OVER f"), "first=1": mode_sql("y / first(y) OVER f", "abs(first(y) OVER f)"),
}
QUERIES = {
    "a2_greedy_merge": merged,
    "j4_count_semi": enough,
    "m6_event_features": events,
    "m12_lens_channels": channels,
    "j2_full_outer_fusion": fusion,
    **{f"x10_mode_{m.replace('=', '_')}": partial(modes, mode=m) for m in V.MODES},
    "w8_display_rolling": smooth,
    "w3_rolling_mad": spreads,
    "a13_weighted_median": medians,
    "x4_first_seen": clock,
    "v1_component_table": component_table,
}
ORACLE_SQL = {
    "a2_greedy_merge": f"""WITH RECURSIVE {LC}, o AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY t, y, s) AS i FROM lc),
      r AS (SELECT source, component, i, t, y, t AS start, 1 AS block FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.component, o.i, o.t, o.y, CASE WHEN o.t - r.start <= 2 THEN r.start ELSE o.t END, CASE WHEN o.t - r.start <= 2 THEN r.block ELSE r.block + 1 END FROM r JOIN o ON o.source = r.source AND o.component = r.component AND o.i = r.i + 1)
      SELECT source, component, round(avg(t), 7) AS t, round(sum(y) / count(*), 7) AS y, count(*) AS n FROM r GROUP BY source, component, block""",
    "j4_count_semi": f"WITH {LC} SELECT source, component, count(*) AS n FROM lc GROUP BY ALL HAVING count(*) > 200",
    "m6_event_features": f"""WITH {_Z}, e AS (SELECT *, row_number() OVER w AS i, count(*) OVER g AS size, coalesce(t - lag(t) OVER w, 0) AS gap, coalesce(z - lag(z) OVER w, 0) AS dz, (t - min(t) OVER g) / (max(t) OVER g - min(t) OVER g) AS rel FROM zz WINDOW w AS (PARTITION BY source, component ORDER BY t, y), g AS (PARTITION BY source, component)),
      e2 AS (SELECT *, CASE WHEN i > 1 THEN greatest(-20, least(20, dz / greatest(gap, 1e-3))) ELSE 0 END AS slope FROM e)
      SELECT source, component, i::INTEGER AS i, round(t, 6) AS t, round(z, 6) AS z, round(ln(1 + gap), 6) AS log_gap, round(rel, 6) AS relative_t, round(slope, 6) AS slope, round(abs(slope), 6) AS slope_size FROM e2 WHERE i > size - 128""",
    "m12_lens_channels": f"""WITH {_Z}, e AS (SELECT *, t - lag(t) OVER w AS bf, lead(t) OVER w - t AS af, row_number() OVER w AS i, sum(z) OVER c AS total, count(z) OVER c AS held, first(z) OVER a AS z0, last(z) OVER a AS z1, (lead(z) OVER w - z) / greatest(lead(t) OVER w - t, 1e-3) AS up
        FROM zz WINDOW w AS (PARTITION BY source, component ORDER BY t, y), c AS (PARTITION BY source, component ORDER BY t, y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), a AS (PARTITION BY source, component ORDER BY t, y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
      h AS (SELECT *, z - (total + (5 - held) * CASE WHEN i <= 2 THEN z0 ELSE z1 END) / 5 AS high, coalesce(up, lag(up) OVER (PARTITION BY source, component ORDER BY t, y), 0) AS rise FROM e)
      SELECT source, component, round(t, 6) AS t, round(z, 6) AS z, round(coalesce(bf, af, 0), 6) AS gap_before, round(coalesce(af, bf, 0), 6) AS gap_after, round(high, 6) AS highpass, round(abs(high), 6) AS highpass_size, round(rise, 6) AS rise FROM h""",
    "j2_full_outer_fusion": f"""WITH {LC}, m AS (SELECT source || '-' || component AS component, count(*) AS n, (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2 / median(s) AS snr FROM lc GROUP BY lc.source, lc.component),
      f AS (SELECT component, snr, snr > 2.2 AS p FROM m WHERE n >= 190), w AS (SELECT component, snr, n > 200 AS p FROM m WHERE n <= 210)
      SELECT component, round(f.snr, 6) AS forest_score, f.p AS forest, round(w.snr, 6) AS network_score, w.p AS network, coalesce(f.p, false) OR coalesce(w.p, false) AS positive FROM f FULL JOIN w USING (component)""",
    **{f"x10_mode_{m.replace('=', '_')}": _MODES[m] for m in V.MODES},
    "w8_display_rolling": f"WITH {BINS} SELECT source, component, bin, round(avg(y) OVER (PARTITION BY source, component ORDER BY t, y, s ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 9) AS smooth FROM b",
    "w3_rolling_mad": f"""WITH {BINS}, o AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY t, y, s) AS i FROM b), x AS (SELECT o.source, o.component, o.bin, n.y FROM o JOIN o AS n ON n.source = o.source AND n.component = o.component AND n.i BETWEEN o.i - 7 AND o.i + 7),
      m AS (SELECT source, component, bin, median(y) AS mid FROM x GROUP BY ALL) SELECT source, component, bin, round(any_value(mid), 11) AS rolling_median, round(greatest(1.4826 * median(abs(y - mid)), 0.05), 11) AS rolling_mad FROM x JOIN m USING (source, component, bin) GROUP BY source, component, bin""",
    "a13_weighted_median": f"WITH {LC}, r AS (SELECT source, component, y, sum(round(s)) OVER (PARTITION BY source, component ORDER BY y, round(s) ROWS UNBOUNDED PRECEDING) AS run, sum(round(s)) OVER (PARTITION BY source, component) AS total FROM lc) SELECT source, component, round(min(y), 8) AS weighted_median FROM r WHERE run >= total / 2 GROUP BY ALL",
    "v1_component_table": f"""WITH {BINS}, m AS (SELECT source, component, t + CASE component WHEN 'N' THEN 12.5 ELSE 0 END AS t, (y - min(y) OVER g) / (max(y) OVER g - min(y) OVER g) AS y, s / (max(y) OVER g - min(y) OVER g) AS s FROM b WHERE component IN ('A', 'N') WINDOW g AS (PARTITION BY source, component)),
      k AS (SELECT source, component, t, CASE component WHEN 'A' THEN y * -2 + 3 ELSE y END AS y, CASE component WHEN 'A' THEN s * 2 ELSE s END AS s FROM m)
      SELECT source, component, round(t, 7) AS t, strftime(make_timestamp(round((t - 2440587.5) * 86400e6::DOUBLE)::BIGINT), '%Y-%m-%d') AS at, round(y, 7) AS y, round(s, 7) AS s,
        round(avg(y) OVER (PARTITION BY source, component ORDER BY t, y, s ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 7) AS smooth, 'component ' || component || CASE component WHEN 'N' THEN ' | delay=12.5 d' ELSE '' END AS label FROM k""",
    "x4_first_seen": "SELECT l_suppkey::VARCHAR AS source, l_returnflag AS component, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS first_seen FROM lineitem GROUP BY ALL",
}
