"""Quality-study analytics: rank correlation, ranges, weights, sensitivity to defects, roll-ups by substance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.operators import quality as Q
from vapora.operators import segments
from vapora.plans import views
from vapora.sources import scratch


def ordinals(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, column (numbers), n and first: each distinct value's count and its first place from 0 in its key's order.

    Values are counted first; a key of more distinct values than segments.ROWS is cut into segments, so no task orders a whole key.
    """
    keys = list(keys)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    parts = segments.cut(counts.withColumn("t", F.col(column).cast("double")), keys).drop("t")
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy(*keys, "seg").agg(F.sum("n").alias("_m")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_m")
    own = F.sum("n").over(Window.partitionBy(*keys, "seg").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("_own", F.coalesce(own, F.lit(0)))
    return placed.join(sizes, [*keys, "seg"]).withColumn("first", F.col("_before") + F.col("_own")).drop("seg", "_before", "_own")


def average_rank(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """df with the rank of column within keys, ties sharing the mean of their ranks."""
    ranks = ordinals(df, keys, column).select(*keys, column, (F.col("first") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, column])


def quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by keys, linear between neighbours, from distinct values' places."""
    keys = list(keys)
    placed = ordinals(scratch.stored(df.select(*keys, column), "values"), keys, column)
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("_total"))
    placed = placed.join(totals, keys) if keys else placed.join(F.broadcast(totals))
    at = lambda p: (F.col("_total") - 1) * p
    value = lambda place: F.max(F.when(F.col("first") <= place, F.col(column)))
    parts = [x for name, p in shares.items() for x in (value(F.floor(at(p))).alias(f"_lo_{name}"), value(F.ceil(at(p))).alias(f"_hi_{name}"), F.max(at(p) - F.floor(at(p))).alias(f"_of_{name}"))]
    g = placed.groupBy(*keys).agg(*parts)
    return g.select(*keys, *((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_of_{name}")).alias(name) for name in shares))


def spearman(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Rank correlation of two columns by keys; NULL for under three pairs and for a constant side."""
    both = scratch.stored(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b), "pairs")  # read by several branches
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("_side"), F.col(c).cast("double").alias("_v")) for side, c in (("a", a), ("b", b))))).alias("s")
    placed = ordinals(both.select(*keys, sides).select(*keys, "s.*"), [*keys, "_side"], "_v")
    ranks = scratch.stored(placed.select(*keys, "_side", "_v", (F.col("first") + (F.col("n") + 1) / 2.0).alias("_r")), "ranks")
    of = lambda side, c: ranks.where(F.col("_side") == side).select(*keys, F.col("_v").alias(c), F.col("_r").alias(f"_r{side}"))
    ranked = both.withColumns({a: F.col(a).cast("double"), b: F.col(b).cast("double")}).join(of("a", a), [*keys, a]).join(of("b", b), [*keys, b])
    g = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_ra").alias("sa"), F.stddev_pop("_rb").alias("sb"), F.covar_pop("_ra", "_rb").alias("c"))
    return g.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("c") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0))).alias("rho"))


def halves(series: DataFrame) -> DataFrame:
    """series (keys, v, n) twice, with half 0 and 1: the first n div 2 values and the rest."""
    keys = [c for c in series.columns if c not in ("t", "v", "n")]
    parts = "array(struct(0 AS half, slice(v, 1, cast(n div 2 AS int)) AS v), struct(1 AS half, slice(v, cast(n div 2 + 1 AS int), size(v)) AS v))"
    return series.where("n >= 2").selectExpr(*keys, f"inline({parts})").withColumn("n", F.expr("cast(size(v) AS long)"))


def half_scores(recordings: DataFrame) -> DataFrame:
    """The quality of each half of each readable recording, as single recordings without baseline and declared range: recording_id, half, subscores."""
    from vapora.sources import recordings as R

    whole = R.series(recordings).select("recording_id", "channel", "v", "n")
    parts = halves(whole).withColumn("recording_id", F.concat_ws("#", "recording_id", "half"))
    times = recordings.where("ok").select(F.col("path").alias("recording_id"), F.lit("t").alias("channel"), F.col("t").alias("v"), F.size("t").cast("long").alias("n"), "rate_hz")
    frames = halves(times).select(F.concat_ws("#", "recording_id", "half").alias("recording_id"), F.transform("v", lambda x, i: i * 1000.0 / F.col("rate_hz")).alias("t"), "n", "rate_hz")
    # a table with a row for each recording is small in its file and large in the driver's memory: never broadcast
    report = Q.quality(parts.drop("half"), Q.declare(frames, rate="rate_hz").drop("rate_hz").hint("merge"))
    return report.select(F.substring_index("recording_id", "#", 1).alias("recording_id"), F.substring_index("recording_id", "#", -1).cast("int").alias("half"), *Q.WEIGHTS)


def subscores_long(report: DataFrame, *keys: str) -> DataFrame:
    return report.unpivot(list(keys), list(Q.WEIGHTS), "subscore", "value")


def subscore_range(long: DataFrame, *keys: str) -> DataFrame:
    """Quartiles, their distance and the measured share of each subscore."""
    g = long.groupBy(*keys).agg(F.avg(F.col("value").isNotNull().cast("double")).alias("measured"))
    q = quantiles(long, keys, "value", {"q1": 0.25, "q3": 0.75})
    both = g.join(q, list(keys), "left") if keys else g.join(F.broadcast(q))
    return both.select(*keys, "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "measured")


def weight_proposal(stats: DataFrame) -> DataFrame:
    """stats (subscore, rho, iqr, measured) with weights in proportion to reliability, range and measured share, summing to 1; 0 where one is missing."""
    raw = F.greatest(F.lit(0.0), F.coalesce("rho", F.lit(0.0))) * F.coalesce("iqr", F.lit(0.0)) * F.coalesce("measured", F.lit(0.0))
    s = stats.withColumn("raw", raw)
    total = s.agg(F.sum("raw").alias("total"))
    return s.join(F.broadcast(total)).select("subscore", F.when(F.col("total") > 0, F.col("raw") / F.nullif(F.col("total"), F.lit(0.0))).otherwise(0.0).alias("weight"))


def sensitivity(scores: DataFrame, least: int = 3) -> DataFrame:
    """scores (defect, subscore, value): how far each subscore falls from defect `none`, summed over defects with enough scores."""
    means = scores.where("value IS NOT NULL").groupBy("subscore", "defect").agg(F.avg("value").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    clean = means.where("defect = 'none'").select("subscore", F.col("m").alias("clean"))
    return means.where("defect <> 'none'").join(clean, "subscore").groupBy("subscore").agg(F.sum(F.greatest(F.lit(0.0), F.col("clean") - F.col("m"))).alias("sensitivity"))


def substance_rollup(sessions: DataFrame) -> DataFrame:
    """sessions (substance, ok) counted by substance."""
    return sessions.groupBy("substance").agg(F.count("*").alias("session_count"), F.count_if("ok").alias("ok_count"))


def collection_report(recordings: DataFrame) -> DataFrame:
    """substance, place (by name), session_count, ok_count and the mean of each subscore over the halves of its readable recordings.

    recordings are those of a folder whose sub-folders are the substances, as sources.recordings.read_recordings gives them.
    """
    counted = substance_rollup(recordings.select("substance", "ok")).withColumn("place", F.row_number().over(Window.orderBy("substance")) - 1)  # a row for each substance
    halves_of = half_scores(recordings).join(recordings.select(F.col("path").alias("recording_id"), "substance").hint("merge"), "recording_id")
    means = halves_of.groupBy("substance").agg(F.count("*").alias("halves"), *(F.avg(c).alias(c) for c in Q.WEIGHTS))
    return counted.join(means, "substance", "left")


def _halves_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = halves(views.stream(spark, sf_dir))
    parts = h.groupBy("recording_id", "channel").pivot("half", [0, 1]).agg(F.first(F.expr(A.mean("v"))).alias("m"))
    return parts.select("channel", F.col("0").alias("a"), F.col("1").alias("b"))


def _q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(_halves_scores(spark, sf_dir), "a", "b", "channel").selectExpr("channel", "n", f"{A.snap('rho', 6)} AS rho")


def _q_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = Q._stream_quality(spark, sf_dir)
    return subscore_range(subscores_long(report, "recording_id"), "subscore").selectExpr("subscore", *(f"{A.snap(c, 5)} AS {c}" for c in ("q1", "q3", "iqr", "measured")))


def _q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substance_rollup(views.table(spark, sf_dir, "events").selectExpr("event_type AS substance", "value > 10 AS ok"))


def _q_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = views.table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_linenumber = 1 THEN 'none' ELSE 'defect' || l_linenumber END AS defect", "l_returnflag || l_linestatus AS subscore", "l_extendedprice / 1000D AS value")
    return sensitivity(scores).selectExpr("subscore", f"{A.snap('sensitivity', 5)} AS sensitivity")


def _q_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a folder of a text for each kind and user, written, listed, read and reported."""
    from vapora.sources import files
    from vapora.sources import recordings as R

    e = views.table(spark, sf_dir, "events").withColumn("path", F.concat_ws("/", "event_type", F.concat(F.lit("u"), "user_id", F.lit(".csv"))))
    line = F.concat_ws(",", (F.col("event_id") * 100).cast("string"), F.format_string("%.2f", "value"))
    rows = e.select("path", "event_id", line.alias("line")).unionByName(e.select("path").distinct().select("path", F.lit(-1).cast("long").alias("event_id"), F.lit("time_ms,VOC").alias("line")))
    at = scratch.folder(spark, "collection")
    # a line is some bytes but its writing is a row's work in Python: dealt by number
    files.write_files(rows.repartition(4 * spark.sparkContext.defaultParallelism, "path").sortWithinPartitions("path", "event_id").select("path", "line"), at)
    report = collection_report(scratch.stored(R.read_recordings(spark, at, "*.csv"), "recordings"))  # listed and parsed once, read by several aggregates
    return report.selectExpr("substance", "cast(place AS int) AS place", "session_count", "ok_count", "halves", f"{A.snap('baselineStability', 6)} AS baseline", f"{A.snap('saturationFree', 4)} AS saturation_free")


QUERIES = {"collection_report": _q_collection, "split_half_spearman": _q_spearman, "subscore_range": _q_range, "substance_rollup": _q_rollup, "defect_sensitivity": _q_sensitivity}

_s = A.snap
_REPORT = Q.ORACLE_SQL["quality_report"].split("SELECT recording_id, (floor")[0]
ORACLE_SQL = {
    "split_half_spearman": f"""WITH {views.STREAM}, h AS (SELECT recording_id, channel, avg(v) FILTER (idx < n // 2) AS a, avg(v) FILTER (idx >= n // 2) AS b FROM stream WHERE n >= 2 GROUP BY 1, 2),
r AS (SELECT channel, rank() OVER (PARTITION BY channel ORDER BY a) + (count(*) OVER (PARTITION BY channel, a) - 1) / 2::DOUBLE AS ra, rank() OVER (PARTITION BY channel ORDER BY b) + (count(*) OVER (PARTITION BY channel, b) - 1) / 2::DOUBLE AS rb FROM h)
SELECT channel, count(*) AS n, {_s('corr(ra, rb)', 6)} AS rho FROM r GROUP BY channel""",
    "subscore_range": f"""{_REPORT}, u AS (SELECT unnest(['continuity', 'dynamicRange', 'saturationFree', 'baselineStability', 'signalStrength', 'recoveryCompleteness', 'durationAdequacy']) AS subscore, unnest([c, dr, sf, st, sig, rec, coalesce(du, 0)]) AS value FROM fin)
SELECT subscore, {_s('quantile_cont(value, 0.25)', 5)} AS q1, {_s('quantile_cont(value, 0.75)', 5)} AS q3, {_s('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 5)} AS iqr, {_s('count(value) / count(*)', 5)} AS measured FROM u GROUP BY subscore""",
    "collection_report": f"""WITH c AS (SELECT event_type, user_id, round(value, 2) AS v, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)),
h AS (SELECT event_type, user_id, idx >= n // 2 AS half, 100::DOUBLE * (1 - (count(*) FILTER (v <= 0))::DOUBLE / count(*)) AS free FROM c WHERE n >= 2 GROUP BY 1, 2, 3),
g AS (SELECT event_type, count(*) AS halves, avg(free) AS free FROM h GROUP BY 1), k AS (SELECT event_type, count(DISTINCT user_id) AS s FROM events GROUP BY 1)
SELECT event_type AS substance, (row_number() OVER (ORDER BY event_type) - 1)::INT AS place, s AS session_count, s AS ok_count, halves, CASE WHEN halves IS NOT NULL THEN 0 END::DOUBLE AS baseline, {_s('free', 4)} AS saturation_free FROM k LEFT JOIN g USING (event_type)""",
    "substance_rollup": "SELECT event_type AS substance, count(*) AS session_count, count(*) FILTER (value > 10) AS ok_count FROM events GROUP BY 1",
    "defect_sensitivity": f"""WITH m AS (SELECT l_returnflag || l_linestatus AS subscore, l_linenumber AS d, avg(l_extendedprice / 1000::DOUBLE) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a.subscore, {_s('sum(greatest(0, c.m - a.m))', 5)} AS sensitivity FROM m a JOIN m c ON a.subscore = c.subscore AND c.d = 1 WHERE a.d > 1 GROUP BY a.subscore""",
}
