"""Quality of recordings: seven subscores, a weighted total, a badge and flags, as one DataFrame plan.

channels: recording_id, channel, v, n. recordings: recording_id, t, n and the declarations rate (Hz), guess_rate (Hz), adc_max,
role, baseline (explicit, auto or none), r0_samples; a NULL is "not declared". A subscore that can't be measured is NULL and
leaves the total; 0 is a measured 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.plans import views

#: Fixed values of the score: weights, full scale, limits.
WEIGHTS = {"continuity": 0.15, "dynamicRange": 0.10, "saturationFree": 0.10, "baselineStability": 0.20, "signalStrength": 0.20, "recoveryCompleteness": 0.15, "durationAdequacy": 0.10}
ADC_MAX, DEAD_CV, NOISE_CV, SNR, FULL_S, SPAN, GAP, NOISE_SPAN, DEAD_PENALTY = 4095.0, 0.001, 0.05, 10.0, 60.0, 0.1, 0.1, 3.0, 12.5
UNIT_RATIO = (0.5, 2.0)


def gaps(recordings: DataFrame) -> DataFrame:
    """recordings with g (gaps) and median_gap, the median of the positive ones."""
    return recordings.withColumn("g", F.expr(A.steps("t"))).withColumn("median_gap", F.expr(A.median("filter(g, x -> x > 0D)")))


def continuity(recordings: DataFrame) -> DataFrame:
    """Share of gaps within a tenth of the nominal period: the declared one, else the median of the positive gaps."""
    r = gaps(recordings)
    r = r.withColumn("unit_ratio", F.expr("CASE WHEN rate > 0D THEN median_gap / (1000D / rate) END"))
    r = r.withColumn("time_unit_mismatch", F.expr(f"coalesce(unit_ratio < {UNIT_RATIO[0]}D OR unit_ratio > {UNIT_RATIO[1]}D, false)"))
    r = r.withColumn("nominal", F.expr("CASE WHEN rate IS NULL THEN median_gap WHEN rate > 0D THEN 1000D / rate END"))
    regular = f"size(filter(g, x -> abs(x - nominal) <= {GAP}D * nominal))"
    r = r.withColumn("regular", F.expr(regular))
    value = "CASE WHEN n < 2 THEN 100D WHEN time_unit_mismatch THEN NULL WHEN nominal > 0D THEN 100D * regular / size(g) ELSE 50D END"
    reason = "CASE WHEN n < 2 THEN 'ok' WHEN time_unit_mismatch THEN 'time_unit_mismatch' WHEN nominal > 0D AND regular = size(g) THEN 'ok' ELSE 'irregular_gaps' END"
    return r.withColumns({"continuity": F.expr(value), "continuity_reason": F.expr(reason)}).drop("unit_ratio", "nominal", "regular", "g")


def channel_scores(channels: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per channel: baseline, dead flag, net span, clipped share, and signal and recovery of the exposure."""
    c = channels.join(recordings.select("recording_id", "adc_max", "baseline", "r0_samples"), "recording_id")
    c = c.withColumn("k", F.expr(f"CASE WHEN r0_samples > 0 THEN r0_samples ELSE {A.window_length('n')} END"))
    c = c.withColumn("f", F.expr(A.finite("v"))).withColumn("b", F.expr(f"CASE WHEN baseline = 'explicit' THEN v ELSE {A.finite('slice(v, 1, k)')} END"))
    c = c.withColumn("m", F.expr(A.median("b")))
    c = c.withColumn("r0", F.expr(f"CASE WHEN size(b) = 0 THEN NULL WHEN m > 0D THEN m ELSE coalesce({A.mean('filter(b, x -> x > 0D)')}, 1D) END")).drop("m")
    c = c.withColumn("cv", F.expr(f"{A.std('b')} / r0")).withColumn("dead", F.expr(f"coalesce({A.std('f')} / r0 < {DEAD_CV}D, false)"))
    c = c.withColumn("u", F.expr("filter(f, x -> adc_max IS NULL OR (x < adc_max AND x > 0D))"))
    c = c.withColumn("s", F.expr("sort_array(u)")).withColumn("cut", F.expr("cast(greatest(1, floor(0.05D * (size(s) - 1))) AS int)"))
    noise = f"coalesce({A.median(A.absolute(A.steps('u')))}, 0D) / 1.4142135623730951D"
    c = c.withColumn("net_span", F.expr(f"CASE WHEN size(u) < 5 THEN 0D ELSE greatest(0D, element_at(s, -1 - cut) - element_at(s, 1 + cut) - {NOISE_SPAN}D * {noise}) END"))
    c = c.withColumn("clipped", F.expr("size(filter(v, x -> x <= 0D OR coalesce(x >= adc_max, false)))"))
    c = c.withColumn("x", F.expr(f"CASE WHEN r0 > 0D THEN {A.relative('u', 'r0')} ELSE cast(array() AS array<double>) END"))
    c = c.withColumn("peak", F.expr("array_max(transform(x, y -> abs(y)))"))
    return c.withColumns({
        "range_score": F.expr(A.clamp(f"net_span / coalesce(adc_max, {ADC_MAX}D) * {1 / SPAN}D")),
        "free_score": F.expr("CASE WHEN size(v) = 0 THEN 100D ELSE 100D * (1D - clipped / size(v)) END"),
        "signal_score": F.expr(f"CASE WHEN size(x) = 0 THEN 0D ELSE 100D * {A.clamp(f'peak / greatest(coalesce(cv, 1D), 1e-6D) / {SNR}D')} END"),
        "recovery_score": F.expr(f"CASE WHEN size(x) = 0 THEN 0D ELSE 100D * (1D - {A.clamp('abs(' + A.median('slice(x, greatest(1, size(x) - 14), 15)') + ') / greatest(peak, 1e-6D)')}) END"),
    }).select("recording_id", "channel", "n", "r0", "cv", "dead", "net_span", "clipped", "range_score", "free_score", "signal_score", "recovery_score")


def quality(channels: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per recording: subscores, reasons, total, badge and flags."""
    return report(channel_scores(channels, recordings), continuity(recordings))


def report(scores: DataFrame, recordings: DataFrame) -> DataFrame:
    """quality() from channel_scores() and continuity()."""
    live = F.expr("NOT dead")
    per = scores.groupBy("recording_id").agg(
        F.avg(F.when(live, F.col("range_score"))).alias("range"), F.avg("free_score").alias("free"), F.avg("cv").alias("mean_cv"),
        F.max(F.when(live, F.col("signal_score"))).alias("signal"), F.avg(F.when(live, F.col("recovery_score"))).alias("recovery"),
        F.count_if("dead").alias("n_dead"), F.array_sort(F.collect_list(F.when(F.col("dead"), F.col("channel")))).alias("dead_sensors"),
    )
    q = recordings.join(per, "recording_id", "left")
    q = q.withColumn("hz", F.expr("coalesce(rate, guess_rate)")).withColumn("seconds", F.expr("CASE WHEN hz > 0D THEN (n - 1) / hz ELSE 0D END"))
    stable = f"100D * {A.clamp(f'1D - mean_cv / {NOISE_CV}D')}"
    exposed = "role = 'exposure' AND baseline <> 'none'"
    q = q.withColumns({
        "dynamicRange": F.expr("100D * coalesce(range, 0D)"),
        "saturationFree": F.col("free"),
        "baselineStability": F.expr(f"CASE WHEN baseline = 'none' THEN 0D WHEN baseline = 'auto' THEN least(coalesce({stable}, 100D), 50D) ELSE coalesce({stable}, 100D) END"),
        "signalStrength": F.expr(f"CASE WHEN {exposed} THEN coalesce(signal, 0D) END"),
        "recoveryCompleteness": F.expr(f"CASE WHEN {exposed} THEN coalesce(recovery, 0D) END"),
        "durationAdequacy": F.expr(f"100D * {A.clamp(f'seconds / {FULL_S}D')}"),
    })
    weighted = " + ".join(f"coalesce({w}D * {c}, 0D)" for c, w in WEIGHTS.items())
    present = " + ".join(f"CASE WHEN {c} IS NULL THEN 0D ELSE {w}D END" for c, w in WEIGHTS.items())
    q = q.withColumn("base", F.expr(f"bround(({weighted}) / nullif({present}, 0D))"))
    q = q.withColumn("total", F.expr(f"cast(CASE WHEN n_dead > 0 THEN bround(greatest(0D, base - least(100D, {DEAD_PENALTY}D * n_dead))) ELSE base END AS int)"))
    q = q.withColumn("badge", F.expr("CASE WHEN total IS NULL THEN 'Unknown' WHEN total >= 90 THEN 'Excellent' WHEN total >= 75 THEN 'Good' WHEN total >= 50 THEN 'Fair' ELSE 'Poor' END"))
    flags = "array_compact(array(CASE WHEN n_dead > 0 THEN 'dead_sensors' END, CASE WHEN time_unit_mismatch THEN 'time_unit_mismatch' END, CASE WHEN adc_max IS NULL THEN 'used_default_adc_max' END, CASE WHEN rate IS NULL THEN 'used_median_sampling_rate' END, CASE WHEN baseline = 'none' THEN 'no_baseline' END, CASE WHEN n = 0 THEN 'empty_recording' END))"
    return q.withColumn("flags", F.expr(flags)).select("recording_id", "n", *WEIGHTS, "continuity_reason", "total", "badge", "n_dead", "dead_sensors", "flags", "median_gap")


def declare(recordings: DataFrame, **declared: str) -> DataFrame:
    """recordings with declarations; each is SQL, NULL unless given, role single and baseline none."""
    said = {"rate": "CAST(NULL AS double)", "guess_rate": "CAST(NULL AS double)", "adc_max": "CAST(NULL AS double)", "role": "'single'", "baseline": "'none'", "r0_samples": "CAST(NULL AS int)"} | declared
    return recordings.withColumns({k: F.expr(v) for k, v in said.items()})


def _stream_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gaps(views.gather(views.stream_samples(spark, sf_dir), "recording_id").drop("v"))
    return declare(r, guess_rate="1000D / median_gap", adc_max="200D", role="'exposure'", baseline="'auto'").drop("g", "median_gap")


def _wave_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir)
    return quality(w.selectExpr("recording_id", "'ch0' AS channel", "v", "n"), declare(w.drop("v"), rate="10D", adc_max="1300D", role="'exposure'", baseline="'explicit'"))


def _stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(views.stream(spark, sf_dir).drop("t"), _stream_recordings(spark, sf_dir))


def _q_net_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir)
    out = channel_scores(w.selectExpr("recording_id", "'ch0' AS channel", "v", "n"), declare(w.drop("v"), adc_max="1300D"))
    return out.selectExpr("recording_id", f"{A.snap('net_span', 5)} AS net_span", f"{A.snap('range_score', 6)} AS range_score")


def _subscores(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _wave_quality(spark, sf_dir).selectExpr("recording_id", *(f"{A.snap(c, 6)} AS {c}" for c in names))

    return query


def _q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_quality(spark, sf_dir).selectExpr("recording_id", *(f"{A.snap(c, 5)} AS {c}" for c in WEIGHTS), "total", "badge", "n_dead", "array_join(flags, ',') AS flags")


QUERIES = {
    "net_span_dynamic_range": _q_net_span,
    "saturation_free": _subscores("saturationFree"),
    "baseline_stability": _subscores("baselineStability"),
    "signal_recovery": _subscores("signalStrength", "recoveryCompleteness"),
    "duration": _subscores("durationAdequacy"),
    "quality_report": _q_report,
}


def _scores_sql(rows: str, adc: float, explicit: bool) -> str:
    """CTEs: per channel scores sc of rows (recording_id, channel, idx, v, n)."""
    k = "n" if explicit else "least(30, greatest(5, floor(n * 0.15::DOUBLE)))"
    by = "recording_id, channel"
    return f"""
qb AS (SELECT {by}, any_value(n) AS n, CASE WHEN median(v) FILTER (idx < {k}) > 0 THEN median(v) FILTER (idx < {k}) ELSE coalesce(avg(v) FILTER (v > 0 AND idx < {k}), 1) END AS r0, stddev_pop(v) FILTER (idx < {k}) AS bs, stddev_pop(v) AS s, count(*) FILTER (v >= {adc} OR v <= 0) AS clipped FROM {rows} GROUP BY {by}),
qu AS (SELECT {by}, idx, v, count(*) OVER (PARTITION BY {by}) AS m, row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS r, row_number() OVER (PARTITION BY {by} ORDER BY idx DESC) AS e, abs(v - lag(v) OVER (PARTITION BY {by} ORDER BY idx)) AS d FROM {rows} WHERE v < {adc} AND v > 0),
qs AS (SELECT {by}, any_value(m) AS m, max(v) FILTER (r = m - 1 - greatest(1, floor(0.05::DOUBLE * (m - 1)))) - max(v) FILTER (r = greatest(1, floor(0.05::DOUBLE * (m - 1)))) AS robust, coalesce(median(d), 0) / 1.4142135623730951::DOUBLE AS noise FROM qu GROUP BY {by}),
qn AS (SELECT {by}, max(abs((v - r0) / r0)) AS peak, median((v - r0) / r0) FILTER (e <= 15) AS fin FROM qu JOIN qb USING ({by}) GROUP BY {by}),
sc AS (SELECT {by}, n, bs / r0 AS cv, s / r0 < 0.001 AS dead, CASE WHEN coalesce(m, 0) < 5 THEN 0 ELSE greatest(0, robust - 3 * noise) END AS net_span, 100::DOUBLE * (1 - clipped / n) AS free, peak, fin FROM qb LEFT JOIN qs USING ({by}) LEFT JOIN qn USING ({by})),
sd AS (SELECT *, greatest(0, least(1, net_span / {adc}::DOUBLE * 10)) AS range_score, CASE WHEN peak IS NULL THEN 0 ELSE 100::DOUBLE * greatest(0, least(1, peak / greatest(cv, 1e-6) / 10)) END AS signal, CASE WHEN peak IS NULL THEN 0 ELSE 100::DOUBLE * (1 - greatest(0, least(1, abs(fin) / greatest(peak, 1e-6)))) END AS recovery FROM sc),
sp AS (SELECT recording_id, 100 * coalesce(avg(range_score) FILTER (NOT dead), 0) AS dr, avg(free) AS sf, 100::DOUBLE * greatest(0, least(1, 1 - avg(cv) / 0.05::DOUBLE)) AS st, coalesce(max(signal) FILTER (NOT dead), 0) AS sig, coalesce(avg(recovery) FILTER (NOT dead), 0) AS rec, count(*) FILTER (dead) AS n_dead FROM sd GROUP BY recording_id)"""


_s = A.snap
_TIMES = "tm AS (SELECT user_id AS recording_id, (epoch_us(ts) // 1000)::DOUBLE - lag((epoch_us(ts) // 1000)::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g, count(*) OVER (PARTITION BY user_id) AS n FROM events), mg AS (SELECT recording_id, any_value(n) AS n, median(g) FILTER (g > 0) AS med FROM tm GROUP BY recording_id), ct AS (SELECT recording_id, any_value(mg.n) AS n, any_value(med) AS med, CASE WHEN any_value(mg.n) < 2 THEN 100 WHEN any_value(med) IS NULL THEN 50 ELSE 100::DOUBLE * count(*) FILTER (abs(g - med) <= 0.1::DOUBLE * med) / count(g) END AS c FROM tm JOIN mg USING (recording_id) GROUP BY recording_id)"
_WAVE_ROWS = f"WITH {views.WAVE}, wr AS (SELECT recording_id, 'ch0' AS channel, idx, v, n FROM wave), {_scores_sql('wr', 1300, True)}"
ORACLE_SQL = {
    "continuity": f"WITH {_TIMES} SELECT recording_id, {_s('c', 6)} AS continuity, CASE WHEN n < 2 OR c = 100 THEN 'ok' ELSE 'irregular_gaps' END AS continuity_reason, false AS time_unit_mismatch FROM ct",
    "gap_period": f"WITH {views.STREAM}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY recording_id, channel ORDER BY idx) AS g FROM stream) SELECT recording_id, channel, any_value(n) AS n, {_s('median(g) FILTER (g > 0)', 3)} AS period_ms, (count(*) FILTER (g <= 0))::INT AS non_positive FROM d GROUP BY recording_id, channel",
    "net_span_dynamic_range": f"WITH {views.WAVE}, wr AS (SELECT recording_id, 'ch0' AS channel, idx, v, n FROM wave), {_scores_sql('wr', 1300, False)} SELECT recording_id, {_s('net_span', 5)} AS net_span, {_s('range_score', 6)} AS range_score FROM sd",
    "saturation_free": f"{_WAVE_ROWS} SELECT recording_id, {_s('sf', 6)} AS \"saturationFree\" FROM sp",
    "baseline_stability": f"{_WAVE_ROWS} SELECT recording_id, {_s('st', 6)} AS \"baselineStability\" FROM sp",
    "signal_recovery": f"{_WAVE_ROWS} SELECT recording_id, {_s('sig', 6)} AS \"signalStrength\", {_s('rec', 6)} AS \"recoveryCompleteness\" FROM sp",
    "duration": f"WITH {views.WAVE} SELECT recording_id, {_s('100::DOUBLE * greatest(0, least(1, (any_value(n) - 1) / 10::DOUBLE / 60))', 6)} AS \"durationAdequacy\" FROM wave GROUP BY recording_id",
    "quality_report": f"""WITH {views.STREAM}, {_TIMES}, {_scores_sql('stream', 200, False)},
al AS (SELECT recording_id, n, c, dr, sf, least(st, 50) AS st, sig, rec, 100::DOUBLE * greatest(0, least(1, (n - 1) / (1000 / med) / 60)) AS du, n_dead FROM ct JOIN sp USING (recording_id)),
tt AS (SELECT *, round_even((0.15::DOUBLE * c + 0.1::DOUBLE * dr + 0.1::DOUBLE * sf + 0.2::DOUBLE * st + 0.2::DOUBLE * sig + 0.15::DOUBLE * rec + 0.1::DOUBLE * coalesce(du, 0)) / (0.15::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE), 0) AS base FROM al),
fin AS (SELECT *, (CASE WHEN n_dead > 0 THEN round_even(greatest(0, base - least(100, 12.5::DOUBLE * n_dead)), 0) ELSE base END)::INT AS total FROM tt)
SELECT recording_id, {_s('c', 5)} AS continuity, {_s('dr', 5)} AS "dynamicRange", {_s('sf', 5)} AS "saturationFree", {_s('st', 5)} AS "baselineStability", {_s('sig', 5)} AS "signalStrength", {_s('rec', 5)} AS "recoveryCompleteness", {_s('du', 5)} AS "durationAdequacy", total,
  CASE WHEN total >= 90 THEN 'Excellent' WHEN total >= 75 THEN 'Good' WHEN total >= 50 THEN 'Fair' ELSE 'Poor' END AS badge, n_dead, CASE WHEN n_dead > 0 THEN 'dead_sensors,' ELSE '' END || 'used_median_sampling_rate' AS flags FROM fin""",
}
