"""Baseline resistance R0 by its three rules, normalisation, channel statistics and window segmentation.

The rules differ on purpose and are never unified:
view A   median of the first finite samples; else the mean of all positive finite samples; else 1.
view B   median of the finite samples of the first rows; else their positive mean; else 1; NULL without any.
legacy   median of the first 15 % of rows, at least 5, without an upper bound; below 1 it is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.plans import views

WINDOW, STRIDE = 100, 10


def with_window(series: DataFrame, declared: int | None = None) -> DataFrame:
    """series with k, the rows of the baseline window: declared if positive, else by the contract."""
    return series.withColumn("k", F.lit(declared) if declared and declared > 0 else F.expr(A.window_length("n")))


def r0_view_a(series: DataFrame, declared: int | None = None) -> DataFrame:
    """series (v, n) with f (finite values), k and r0."""
    series = with_window(series, declared).withColumn("f", F.expr(A.finite("v")))
    k = f"{declared}" if declared and declared > 0 else A.window_length("size(f)")
    series = series.withColumn("m", F.expr(A.median(f"slice(f, 1, {k})")))
    positive = A.mean("filter(f, x -> x > 0D)")
    return series.withColumn("r0", F.expr(f"CASE WHEN m > 0D THEN m ELSE coalesce({positive}, 1D) END")).drop("m")


def r0_view_b(series: DataFrame, declared: int | None = None) -> DataFrame:
    """series with k, b (the window's finite values), r0 and cv, which is infinite where r0 is 0."""
    series = with_window(series, declared).withColumn("b", F.expr(A.finite("slice(v, 1, k)")))
    series = series.withColumn("m", F.expr(A.median("b")))
    r0 = f"CASE WHEN size(b) = 0 THEN NULL WHEN m > 0D THEN m ELSE coalesce({A.mean('filter(b, x -> x > 0D)')}, 1D) END"
    return series.withColumn("r0", F.expr(r0)).drop("m").withColumn("cv", F.expr(f"CASE WHEN r0 = 0D THEN double('infinity') ELSE {A.std('b')} / r0 END"))


def r0_legacy(series: DataFrame) -> DataFrame:
    series = series.withColumn("m", F.expr(A.median("slice(v, 1, cast(greatest(5, floor(n * 0.15D)) AS int))")))
    return series.withColumn("r0", F.expr("CASE WHEN m < 1D THEN 1D ELSE m END")).drop("m")


def normalised(series: DataFrame) -> DataFrame:
    """series with x, the values relative to r0; all NaN where r0 isn't positive and finite."""
    return series.withColumn("x", F.expr(f"CASE WHEN r0 > 0D AND r0 < double('infinity') THEN {A.relative('v', 'r0')} ELSE transform(v, y -> double('NaN')) END"))


def channel_stats(series: DataFrame) -> DataFrame:
    """series (v, r0) with its finite minimum, maximum, mean, deviation, cv, dead flag, span and count of values that aren't finite."""
    series = series.withColumn("f", F.expr(A.finite("v")))
    series = series.withColumns({"v_min": F.expr("array_min(f)"), "v_max": F.expr("array_max(f)"), "v_mean": F.expr(A.mean("f")), "v_std": F.expr(A.std("f")), "non_finite": F.expr("cast(size(v) - size(f) AS long)")})
    series = series.withColumn("v_cv", F.expr("CASE WHEN r0 > 0D THEN v_std / r0 ELSE double('infinity') END"))
    return series.withColumns({"dead": F.expr("coalesce(v_cv < 0.001D, false)"), "span": F.expr("v_max - v_min")})


def segment(series: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """One row per window: series' key columns, window_id, w. A shorter recording is one window, padded with its last value."""
    keys = [c for c in series.columns if c not in ("v", "t", "n")]
    padded = series.withColumn("p", F.expr(f"CASE WHEN n < {size} THEN concat(v, array_repeat(element_at(v, -1), cast({size} - n AS int))) ELSE v END"))
    windows = F.expr(f"transform(sequence(0, cast(greatest(0, n - {size}) div {stride} AS int)), i -> slice(p, i * {stride} + 1, {size}))")
    return padded.where("n > 0").select(*keys, "n", F.posexplode(windows).alias("window_id", "w"))


def _q_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = channel_stats(r0_view_b(views.stream(spark, sf_dir)))
    return out.selectExpr("recording_id", "channel", "n", *(f"{A.snap(c, 4)} AS {c}" for c in ("v_min", "v_max", "v_mean", "v_std", "r0", "v_cv", "span")), "dead", "non_finite")


def _q_r0_window_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_window(views.longrun(spark, sf_dir)).select("recording_id", "n", "k")


def _q_r0_view_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0_view_a(views.wave(spark, sf_dir)).selectExpr("recording_id", "k", f"{A.snap('r0', 6)} AS r0")


def _q_r0_view_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0_view_b(views.stream(spark, sf_dir)).selectExpr("recording_id", "channel", "k", f"{A.snap('r0', 6)} AS r0", f"{A.snap('cv', 6)} AS cv")


def _q_normalize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r0_legacy(views.wave(spark, sf_dir))
    return out.selectExpr("recording_id", "r0", f"posexplode({A.relative('v', 'r0')}) AS (idx, x)").selectExpr("recording_id", "idx", f"{A.snap('x', 6)} AS x")


def _q_normalized_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalised(r0_view_b(views.wave(spark, sf_dir)))
    return out.selectExpr("recording_id", "posexplode(x) AS (idx, x)").selectExpr("recording_id", "idx", f"{A.snap('x', 6)} AS x")


def _q_segment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = segment(views.longrun(spark, sf_dir)).withColumn("source", F.lit("longrun"))
    short = segment(views.wave(spark, sf_dir)).withColumn("source", F.lit("wave"))
    return long.unionByName(short).selectExpr("source", "recording_id", "window_id", "size(w) AS size", f"{A.snap('element_at(w, 1)', 4)} AS first_value", f"{A.snap('element_at(w, -1)', 4)} AS last_value", f"{A.snap(A.mean('w'), 4)} AS mean_value")


QUERIES = {
    "channel_stats": _q_channel_stats,
    "r0_window_size": _q_r0_window_size,
    "r0_view_a": _q_r0_view_a,
    "r0_view_b": _q_r0_view_b,
    "normalize_legacy": _q_normalize_legacy,
    "normalized_series": _q_normalized_series,
    "segment_windows": _q_segment_windows,
}

K_SQL = "least(30, greatest(5, floor(n * 0.15::DOUBLE)))::INT"
#: Baselines of the wave view after view A, and of the stream view after view B.
R0_WAVE = f"r0 AS (SELECT recording_id, any_value(n) AS n, {K_SQL.replace('n *', 'any_value(n) *')} AS k, CASE WHEN median(v) FILTER (idx < {K_SQL}) > 0 THEN median(v) FILTER (idx < {K_SQL}) ELSE coalesce(avg(v) FILTER (v > 0), 1) END AS r0 FROM wave GROUP BY recording_id)"
R0_STREAM = f"""r0 AS (SELECT recording_id, channel, any_value(n) AS n, any_value({K_SQL}) AS k,
  CASE WHEN median(v) FILTER (idx < {K_SQL}) > 0 THEN median(v) FILTER (idx < {K_SQL}) ELSE coalesce(avg(v) FILTER (v > 0 AND idx < {K_SQL}), 1) END AS r0, stddev_pop(v) FILTER (idx < {K_SQL}) AS s
  FROM stream GROUP BY recording_id, channel)"""

ORACLE_SQL = {
    "channel_stats": f"""WITH {views.STREAM}, {R0_STREAM}, g AS (SELECT recording_id, channel, count(*) AS n, min(v) AS v_min, max(v) AS v_max, avg(v) AS v_mean, stddev_pop(v) AS v_std FROM stream GROUP BY 1, 2)
SELECT g.recording_id, g.channel, g.n, {A.snap('v_min', 4)} AS v_min, {A.snap('v_max', 4)} AS v_max, {A.snap('v_mean', 4)} AS v_mean, {A.snap('v_std', 4)} AS v_std, {A.snap('r0', 4)} AS r0, {A.snap('v_std / r0', 4)} AS v_cv, {A.snap('v_max - v_min', 4)} AS span, v_std / r0 < 0.001 AS dead, 0::BIGINT AS non_finite
FROM g JOIN r0 USING (recording_id, channel)""",
    "r0_window_size": f"WITH {views.LONGRUN} SELECT recording_id, any_value(n) AS n, any_value({K_SQL}) AS k FROM longrun GROUP BY recording_id",
    "r0_view_a": f"WITH {views.WAVE}, {R0_WAVE} SELECT recording_id, k, {A.snap('r0', 6)} AS r0 FROM r0",
    "r0_view_b": f"WITH {views.STREAM}, {R0_STREAM} SELECT recording_id, channel, k, {A.snap('r0', 6)} AS r0, {A.snap('s / r0', 6)} AS cv FROM r0",
    "normalize_legacy": f"""WITH {views.WAVE}, b AS (SELECT recording_id, median(v) FILTER (idx < greatest(5, floor(n * 0.15::DOUBLE))) AS m FROM wave GROUP BY recording_id),
c AS (SELECT recording_id, CASE WHEN m < 1 THEN 1::DOUBLE ELSE m END AS r0 FROM b)
SELECT recording_id, idx::INT AS idx, {A.snap('(v - r0) / r0', 6)} AS x FROM wave JOIN c USING (recording_id)""",
    "normalized_series": f"WITH {views.WAVE}, {R0_WAVE} SELECT recording_id, idx::INT AS idx, {A.snap('(v - r0) / r0', 6)} AS x FROM wave JOIN r0 USING (recording_id)",
    "segment_windows": f"""WITH {views.LONGRUN}, {views.WAVE}, w AS (SELECT 'longrun' AS source, recording_id, idx, v, n FROM longrun UNION ALL SELECT 'wave', recording_id, idx, v, n FROM wave),
lists AS (SELECT source, recording_id, list(v ORDER BY idx) AS l, any_value(n) AS n FROM w GROUP BY 1, 2),
padded AS (SELECT source, recording_id, n, CASE WHEN n < 100 THEN list_concat(l, list_transform(range(100 - n), lambda i: l[n])) ELSE l END AS l FROM lists),
s AS (SELECT source, recording_id, l, unnest(range(greatest(0, n - 100) // 10 + 1)) AS window_id FROM padded)
SELECT source, recording_id, window_id::INT AS window_id, 100 AS size, {A.snap('l[window_id * 10 + 1]', 4)} AS first_value, {A.snap('l[window_id * 10 + 100]', 4)} AS last_value, {A.snap('list_avg(l[window_id * 10 + 1 : window_id * 10 + 100])', 4)} AS mean_value FROM s""",
}
