"""Timing limits: cadence, scan skew and its removal, the shortest event that a cadence resolves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.plans import views

#: Skew beyond this share of the sample period is flagged; fewer samples can't characterise timing.
SKEW_SHARE, LEAST_SAMPLES = 0.5, 3


def scan_offset(channel: Column, sweep_s: float) -> Column:
    """Seconds by which a channel, counted from 0, is read after its frame's time stamp."""
    return channel * F.lit(float(sweep_s))


def deskew(channels: DataFrame, sweep_s: float, period_s: float) -> DataFrame:
    """channels (ch_idx from 0, v, n) with v shifted to the common time base; the tail that has no data is NULL."""
    if period_s <= 0 or sweep_s < 0:
        raise ValueError("the sample period must be positive and the sweep not negative")
    shift = F.expr(f"cast(greatest(0, least(n - 1, floor(ch_idx * {float(sweep_s)!r}D / {float(period_s)!r}D))) AS int)")
    moved = F.expr("concat(slice(v, shift + 1, size(v)), array_repeat(cast(NULL AS double), shift))")
    return channels.withColumn("shift", shift).withColumn("v", moved)


def least_duration(rate_hz: Column) -> Column:
    """Shortest event in seconds that a cadence resolves: two samples; NULL for a rate that isn't positive."""
    return F.when(rate_hz > 0, 2.0 / rate_hz)


def resolvable(duration_s: Column, rate_hz: Column) -> Column:
    return duration_s >= least_duration(rate_hz)


def restrict_to_resolvable(duration_s: Column, rate_hz: Column) -> Column:
    return F.when(resolvable(duration_s, rate_hz), duration_s)


def timing_report(recordings: DataFrame) -> DataFrame:
    """recordings (recording_id, t in seconds or NULL, declared_hz, n_channels, sweep_s) with cadence, its source, skew and flags."""
    r = recordings.withColumn("n_samples", F.expr("coalesce(size(t), 0)")).withColumn("measured", F.expr(f"CASE WHEN n_samples >= 2 THEN {A.median('filter(' + A.steps('t') + ', x -> x > 0D)')} END"))
    r = r.withColumn("sample_period_s", F.expr("coalesce(measured, CASE WHEN declared_hz > 0D THEN 1D / declared_hz END)"))
    r = r.withColumn("sampling_rate_hz", F.expr("CASE WHEN measured IS NULL AND declared_hz > 0D THEN declared_hz ELSE 1D / sample_period_s END"))
    r = r.withColumn("rate_source", F.expr("CASE WHEN measured IS NOT NULL THEN 'timestamps' WHEN declared_hz > 0D OR (t IS NULL AND declared_hz IS NOT NULL) THEN 'declared' ELSE 'unavailable' END"))
    r = r.withColumn("max_skew_s", F.expr("CASE WHEN n_channels > 1 THEN sweep_s * (n_channels - 1) END")).withColumn("skew_share", F.expr("max_skew_s / sample_period_s"))
    fraction = "transform(sequence(0, n_channels - 1), i -> abs(i * sweep_s / sample_period_s - bround(i * sweep_s / sample_period_s)))"
    r = r.withColumn("residual_s", F.expr(f"CASE WHEN skew_share IS NOT NULL THEN array_max({fraction}) * sample_period_s END"))
    flags = [
        (f"n_samples > 0 AND n_samples < {LEAST_SAMPLES}", "too_few_samples_to_characterise_timing"),
        ("n_samples >= 2 AND measured IS NULL", "timestamps_contain_no_positive_step"),
        ("rate_source = 'unavailable'", "cadence_unknown"),
        ("declared_hz <= 0D", "declared_rate_not_positive"),
        ("NOT coalesce(declared_hz <= 0D, false) AND sampling_rate_hz < 1D", "cadence_below_1hz"),
        (f"skew_share > {SKEW_SHARE}D", "channel_sweep_exceeds_half_sample_period"),
        ("sweep_s IS NOT NULL AND coalesce(n_channels, 0) <= 1", "single_channel_so_sweep_is_irrelevant"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in flags)
    return r.withColumns({"least_duration_s": F.expr("2D / sampling_rate_hz"), "flags": F.expr(f"array_compact(array({listed}))"), "needs_deskew": F.expr(f"coalesce(skew_share > {SKEW_SHARE}D, false)")}).drop("measured")


def _q_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir).selectExpr("recording_id div 4 AS recording_id", "cast(recording_id % 4 AS int) AS ch_idx", "v", "n")
    return deskew(w, 0.25, 0.1).selectExpr("recording_id", "ch_idx", "posexplode(v) AS (idx, value)").selectExpr("recording_id", "ch_idx", "idx", f"{A.snap('value', 5)} AS value")


def _q_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.gather(views.stream_samples(spark, sf_dir), "recording_id")
    r = r.selectExpr("recording_id", "transform(t, x -> x / 1000D) AS t", "cast(NULL AS double) AS declared_hz", "cast(5 AS int) AS n_channels", "900D AS sweep_s")
    out = timing_report(r)
    return out.selectExpr("recording_id", "n_samples", f"{A.snap('sample_period_s', 4)} AS sample_period_s", f"{A.snap('sampling_rate_hz', 9)} AS sampling_rate_hz", f"{A.snap('least_duration_s', 3)} AS least_duration_s", f"{A.snap('max_skew_s', 4)} AS max_skew_s", f"{A.snap('skew_share', 6)} AS skew_share", "rate_source", "array_join(flags, ',') AS flags")


QUERIES = {"deskew": _q_deskew, "timing_report": _q_timing}

_s = A.snap
ORACLE_SQL = {
    "deskew": f"""WITH {views.WAVE}, c AS (SELECT recording_id // 4 AS recording_id, (recording_id % 4)::INT AS ch_idx, idx, v, n, floor((recording_id % 4) * 0.25::DOUBLE / 0.1::DOUBLE)::INT AS shift FROM wave)
SELECT a.recording_id, a.ch_idx, a.idx::INT AS idx, {_s('b.v', 5)} AS value FROM c a LEFT JOIN c b ON a.recording_id = b.recording_id AND a.ch_idx = b.ch_idx AND b.idx = a.idx + a.shift""",
    "timing_report": f"""WITH g AS (SELECT user_id, (epoch_us(ts) // 1000)::DOUBLE / 1000 - lag((epoch_us(ts) // 1000)::DOUBLE / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
p AS (SELECT user_id AS recording_id, count(*)::INT AS n, median(g) FILTER (g > 0) AS p FROM g GROUP BY user_id)
SELECT recording_id, n AS n_samples, {_s('p', 4)} AS sample_period_s, {_s('1 / p', 9)} AS sampling_rate_hz, {_s('2 / (1 / p)', 3)} AS least_duration_s, {_s('3600', 4)} AS max_skew_s, {_s('3600 / p', 6)} AS skew_share, 'timestamps' AS rate_source,
  array_to_string(list_filter([CASE WHEN n < 3 THEN 'too_few_samples_to_characterise_timing' END, CASE WHEN 1 / p < 1 THEN 'cadence_below_1hz' END, CASE WHEN 3600 / p > 0.5 THEN 'channel_sweep_exceeds_half_sample_period' END], lambda x: x IS NOT NULL), ',') AS flags FROM p WHERE p IS NOT NULL""",
}
