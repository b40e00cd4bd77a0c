"""What a recording file is, whether it is sound, and what its channels say: a row per file, errors as columns.

All functions take recordings as sources.recordings.read_recordings gives them. A file that couldn't be read keeps its row with
ok false and its error; nothing here stops a scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.functions import sensors
from vapora.operators import features, kinetics
from vapora.operators.baseline import r0_view_a
from vapora.plans import manifest, views
from vapora.sources import recordings as R


def _wanted(channels: Sequence[str] | Mapping[str, str] | None) -> Column:
    return F.col("channel_ids") if channels is None else F.array(*(F.lit(c) for c in channels)).cast("array<string>")


def channel_matrix(recordings: DataFrame, channels: Sequence[str] | Mapping[str, str] | None = None) -> DataFrame:
    """path, columns, n and matrix, an array per chosen channel in the order asked for; error says which channels are missing.

    A mapping renames channels. Series shorter than the times are filled with NaN, longer ones are cut.
    """
    names = dict(channels) if isinstance(channels, Mapping) else {}
    wanted = _wanted(channels)
    missing = F.array_except(wanted, F.coalesce("channel_ids", F.array().cast("array<string>")))
    n = F.size("t")
    fitted = lambda v: F.concat(F.slice(v, F.lit(1), n), F.array_repeat(F.lit(float("nan")), F.greatest(F.lit(0), n - F.size(v))))
    rows = F.transform(wanted, lambda c: fitted(F.coalesce(F.element_at("channels", c), F.array().cast("array<double>"))))
    renamed = F.transform(wanted, lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v))), c), c)) if names else wanted
    error = F.when(~F.col("ok"), F.concat(F.lit("ingest failed: "), "error")).when(F.size(wanted) == 0, "no channels").when(F.size(missing) > 0, F.concat(F.lit("missing channels: "), F.array_join(missing, ", ")))
    out = recordings.select("path", renamed.alias("columns"), n.alias("n"), rows.alias("matrix"), error.alias("error"))
    return out.withColumn("matrix", F.when(F.col("error").isNull(), F.col("matrix")))


def _models() -> Column:
    return F.create_map(*(F.lit(x) for m in sensors.model_names() for x in (sensors.key(m), m)))


def inspect(recordings: DataFrame) -> DataFrame:
    """path, sensor_type, feature_family, the model of each channel that bears a tabulated name, the other channels, and warnings."""
    models = F.filter(F.transform("channel_ids", lambda c: F.struct(c.alias("channel"), F.element_at(_models(), sensors.key_column(c)).alias("model"))), lambda s: s["model"].isNotNull())
    r = recordings.where("ok").withColumn("models", models)
    inferred = (F.col("sensor_type") == "unknown") & (F.size("models") > 0)
    r = r.withColumn("inferred", inferred).withColumn("sensor_type", F.when(inferred, "mox").otherwise(F.col("sensor_type")))
    family = F.when(F.col("sensor_type") == "mox", "mox").when(F.col("sensor_type") == "unknown", "mox-compatible").otherwise("unsupported")
    hints = F.array(
        F.when(F.col("inferred"), F.concat(F.lit("sensor type taken from model names: "), F.array_join(F.transform("models", lambda s: F.concat_ws("=", s["channel"], s["model"])), ", "))),
        F.when(F.col("sensor_type") == "unknown", "no known model: features of the signal alone, concentrations nominal"),
        F.when((F.col("sensor_type") == "mox") & (F.size("models") == 0), "no channel bears a tabulated model's name"),
    )
    return r.select(
        "path", "sensor_type", family.alias("feature_family"), "channel_ids", F.map_from_entries("models").alias("models"), F.array_except("channel_ids", F.transform("models", lambda s: s["channel"])).alias("unmodeled"),
        "rate_hz", "time_source", "context_ids", "inferred", F.concat("warnings", F.array_compact(hints)).alias("warnings"),
    )


def validate(recordings: DataFrame) -> DataFrame:
    """path, format, valid, errors and warnings, with what a sound file holds."""
    bundle = F.col("manifest").isNotNull()
    declared = manifest.from_json("manifest")["sensor"]["samplingRateHz"]
    errors = F.array_compact(F.array(F.when(~F.col("ok"), F.col("error")), F.when(F.col("ok") & (F.size("channel_ids") == 0), "no channels"), F.when(F.col("ok") & (F.size("t") == 0), "no rows")))
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(F.array(F.when(bundle & declared.isNull(), "no declared sampling rate: features per second are approximate"))))
    return recordings.select(
        "path", F.when(bundle, "bundle").otherwise("csv").alias("format"), (F.size(errors) == 0).alias("valid"), "sensor_type", F.col("channel_ids").alias("channels"),
        F.when(F.col("ok"), F.size("t")).alias("sample_count"), "time_source", errors.alias("errors"), warnings.alias("warnings"),
    )


def analyze(recordings: DataFrame) -> DataFrame:
    """validate() with a struct of kinetic features for each channel, in the channels' order."""
    rows = kinetics.kinetics(R.series(recordings))
    names = ("r0", "relative_amplitude", "direction", "dead", "saturation_index", "rise_time_ms", "decay_time_ms", "auc", "endpoint_delta")
    by_file = rows.groupBy(F.col("recording_id").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ch_idx", "channel", *names))).alias("features"))
    return validate(recordings).join(by_file, "path", "left")


def health(recordings: DataFrame, r0_samples: int | None = None) -> DataFrame:
    """Drift, decay of sensitivity, noise and hysteresis of every channel, over the declared or the contract's baseline window."""
    if r0_samples is not None and r0_samples <= 0:
        raise ValueError(f"r0_samples must be positive, not {r0_samples}")
    rate = recordings.where("ok").select(F.col("path").alias("recording_id"), F.when(F.col("rate_hz") > 0, F.col("rate_hz")).alias("rate_hz"), "time_source")
    h = features.health(r0_view_a(R.series(recordings), r0_samples), 1.0).join(rate, "recording_id")
    sr = F.coalesce("rate_hz", F.lit(R.RATE_HZ))
    return h.select("recording_id", "channel", "n", F.col("k").alias("r0_window"), (F.col("drift_rate") * sr).alias("drift_rate"), "sensitivity_decay", "noise_floor", "hysteresis", sr.alias("rate_hz"), (F.col("time_source") != "column").alias("approximate"))


def absolute_by_channel(series: DataFrame, calibration: DataFrame) -> DataFrame:
    """features.absolute() of series (recording_id, channel, v, n, r0) under each channel's own law; the nominal one where none is declared.

    calibration has recording_id, channel, a and b, at most a row for each channel; entries with a not above 0 or b 0 don't count.
    """
    own = calibration.where("a > 0 AND b <> 0").select("recording_id", "channel", "a", "b")
    s = features.absolute(series).drop("calibrated_concentration").join(own, ["recording_id", "channel"], "left")
    s = s.withColumns({"calibration_source": F.when(F.col("a").isNull(), "nominal-default").otherwise("manifest"), "a": F.coalesce("a", F.lit(features.NOMINAL[0])), "b": F.coalesce("b", F.lit(features.NOMINAL[1]))})
    return s.withColumn("calibrated_concentration", F.expr("CASE WHEN raw_resistance / r0 > 0D THEN pow(raw_resistance / r0 / greatest(a, 0.001D), 1D / b) ELSE 0D END"))


def suggestions(names: DataFrame, column: str, most: int = 3) -> DataFrame:
    """names that no model bears, with the models whose keys are the fewest edits away, the best first."""
    models = [(m, sensors.key(m)) for m in sensors.model_names()]
    near = F.array(*(F.struct(F.levenshtein(F.col("k"), F.lit(k)).alias("edits"), F.lit(m).alias("model")) for m, k in models))
    unknown = names.withColumn("k", sensors.key_column(F.col(column))).where(~F.col("k").isin(*(k for _, k in models)))
    return unknown.withColumn("close", F.transform(F.slice(F.array_sort(near), 1, most), lambda s: s["model"])).drop("k")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reparse(R._texts(spark, sf_dir))


def _q_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = channel_matrix(_made(spark, sf_dir), {"CO": "carbon monoxide", "VOC": "voc"})
    total = lambda k: F.floor(F.aggregate(F.filter(F.col("matrix")[k], lambda x: ~F.isnan(x)), F.lit(0.0), lambda a, x: a + x) * 1000 + 0.50037) / 1000
    return m.select("path", F.array_join("columns", ",").alias("columns"), "n", total(0).alias("first_sum"), total(1).alias("second_sum"), "error")


def _q_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inspect(_made(spark, sf_dir))
    return i.select("path", "sensor_type", "feature_family", F.size("models").alias("n_models"), F.array_join("unmodeled", ",").alias("unmodeled"), F.size("warnings").alias("n_warnings"), "inferred")


def _named_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a text whose first channel bears a sensor model's name, spelt in a user's way."""
    names = F.array(*(F.lit(m) for m in sensors.model_names()))
    e = views.table(spark, sf_dir, "events")
    model = F.element_at(names, (F.col("user_id") % len(sensors.model_names()) + 1).cast("int"))
    spelt = F.when(F.col("user_id") % 3 == 0, F.lower(model)).when(F.col("user_id") % 3 == 1, F.replace(model, F.lit("-"), F.lit(" "))).otherwise(model)
    line = F.concat_ws(",", (F.col("event_id") * 100).cast("string"), F.format_string("%.2f", "value"), F.lit("7"))
    g = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return g.select(F.concat(F.lit("user/"), "user_id").alias("path"), F.encode(F.concat(F.lit("time_ms,"), spelt, F.lit(",other\n"), "body"), "UTF-8").alias("content"))


def _q_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inspect(R.reparse(_named_models(spark, sf_dir)))
    pairs = F.transform(F.map_entries("models"), lambda m: F.concat_ws("=", m["key"], m["value"]))
    return i.select("path", "sensor_type", "feature_family", F.array_join(pairs, ",").alias("models"), F.array_join("unmodeled", ",").alias("unmodeled"), "inferred")


def _q_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's sensor, however it is spelt, can be verified by; NULL for unknown ones."""
    from vapora.operators.calibration import spellings

    named = sensors.normalise_sensor(spellings(spark, sf_dir).select("p_partkey", "sensor"), "sensor").select("p_partkey", "model")
    return named.join(F.broadcast(sensors.sources(spark)), "model", "left").select("p_partkey", "model", "place", "source")


def _q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R._texts(spark, sf_dir)
    bad = t.select(F.concat("path", F.lit("/empty")).alias("path"), F.lit(b"# nothing\n").alias("content"))
    v = validate(R.reparse(t.unionByName(bad)))
    return v.select("path", "format", "valid", "sample_count", F.size("errors").alias("n_errors"), F.array_join("channels", ",").alias("channels"))


def _q_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyze(_made(spark, sf_dir)).select("path", "valid", F.explode("features").alias("f"))
    return a.select("path", "valid", "f.channel", "f.dead", A_snap("f.r0", "r0"), A_snap("f.endpoint_delta", "endpoint_delta"))


def A_snap(column: str, name: str) -> Column:
    return F.expr(f"{A.snap(column, 6)} AS {name}")


def _q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health(R.reparse(R._texts(spark, sf_dir)))
    return h.select(F.col("recording_id").alias("path"), "channel", "n", "r0_window", A_snap("noise_floor", "noise_floor"), "approximate")


def _q_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir).selectExpr("recording_id", "cast(recording_id % 3 AS string) AS channel", "v", "n")
    laws = w.where("channel <> '0'").selectExpr("recording_id", "channel", "CASE channel WHEN '1' THEN 1.5D ELSE -1D END AS a", "-0.8D AS b")
    out = absolute_by_channel(r0_view_a(w), laws)
    return out.selectExpr("recording_id", "channel", "calibration_source", f"{A.snap('calibrated_concentration', 5)} AS concentration")


def _q_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vapora.operators.calibration import spellings

    s = suggestions(spellings(spark, sf_dir).select("p_partkey", "sensor"), "sensor")
    return s.select("p_partkey", "sensor", F.array_join("close", ",").alias("close"))


QUERIES = {
    "channel_matrix": _q_matrix, "inspect_source": _q_inspect, "inspect_models": _q_models, "sensor_sources": _q_sources, "validate_recording": _q_validate, "analyze_recording": _q_analyze, "recording_health": _q_health,
    "absolute_by_channel": _q_absolute, "sensor_suggestions": _q_suggest,
}

_GOOD = "e AS (SELECT 'user/' || user_id AS path, event_id, epoch_us(ts) // 1000 AS ms, round(value, 2) AS voc, (event_id % 97)::DOUBLE AS co FROM events WHERE event_id % 50 <> 0)"
#: Samples of both channels in time order, as files hold them.
_SAMPLES = f"{_GOOD}, sm AS (SELECT path, c.channel, c.v, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY path, c.channel) AS n FROM (SELECT path, ms, event_id, unnest([{{'channel': 'VOC', 'v': voc}}, {{'channel': 'CO', 'v': co}}]) AS c FROM e) WINDOW w AS (PARTITION BY path, c.channel ORDER BY ms, event_id))"
_s = A.snap
_MODEL_KEYS = "md(model, k) AS (VALUES " + ", ".join(f"('{m}', '{sensors.key(m)}')" for m in sensors.model_names()) + ")"
ORACLE_SQL = {
    "channel_matrix": f"WITH {_GOOD} SELECT path, 'carbon monoxide,voc' AS columns, count(*)::INT AS n, floor(sum(co) * 1000 + 0.50037) / 1000 AS first_sum, floor(sum(voc) * 1000 + 0.50037) / 1000 AS second_sum, NULL::VARCHAR AS error FROM e GROUP BY path",
    "inspect_source": f"WITH {_GOOD} SELECT DISTINCT path, 'mox' AS sensor_type, 'mox' AS feature_family, 0 AS n_models, 'VOC,CO' AS unmodeled, 2 AS n_warnings, false AS inferred FROM e",
    "inspect_models": f"""WITH {_MODEL_KEYS}, o AS (SELECT *, row_number() OVER () - 1 AS i FROM md), u AS (SELECT DISTINCT user_id, o.model FROM events JOIN o ON user_id % {len(sensors.model_names())} = i)
SELECT 'user/' || user_id AS path, 'mox' AS sensor_type, 'mox' AS feature_family, CASE user_id % 3 WHEN 0 THEN lower(model) WHEN 1 THEN replace(model, '-', ' ') ELSE model END || '=' || model AS models, 'other' AS unmodeled, false AS inferred FROM u""",
    "sensor_sources": f"""WITH sp AS (SELECT p_partkey, ['mq', 'MQ-', 'Mq_', 'mq '][p_size % 4 + 1] || ['2', '3', '135', '8', '99', '309a', '7'][p_partkey % 7 + 1] AS sensor FROM part), {_MODEL_KEYS}, so(model, place, source) AS (VALUES {', '.join(f"('{m}', {k}, '{url}')" for m, k, url in sensors.source_rows())})
SELECT p_partkey, md.model, place, source FROM sp LEFT JOIN md ON md.k = regexp_replace(upper(sensor), '[^A-Z0-9]', '', 'g') LEFT JOIN so ON so.model = md.model""",
    "validate_recording": f"WITH {_GOOD} SELECT path, 'csv' AS format, true AS valid, count(*)::INT AS sample_count, 0 AS n_errors, 'VOC,CO' AS channels FROM e GROUP BY path UNION ALL SELECT DISTINCT path || '/empty', 'csv', false, NULL, 1, NULL FROM e",
    "analyze_recording": f"""WITH {_SAMPLES}, k AS (SELECT *, CASE WHEN n = 0 THEN 5 ELSE least(30, greatest(5, floor(n * 0.15::DOUBLE)))::INT END AS k FROM sm),
g AS (SELECT path, channel, median(v) FILTER (idx < k) AS r0, arg_max(v, idx) AS last_v, stddev_pop(v) AS sd FROM k GROUP BY 1, 2)
SELECT path, true AS valid, channel, sd / nullif(r0, 0) < 0.001 AS dead, {_s('r0', 6)} AS r0, {_s('(last_v - r0) / r0', 6)} AS endpoint_delta FROM g""",
    "recording_health": f"""WITH {_SAMPLES}, k AS (SELECT *, least(30, greatest(5, floor(n * 0.15::DOUBLE)))::INT AS k FROM sm),
g AS (SELECT path, channel, any_value(n) AS n, any_value(k) AS k, median(v) FILTER (idx < k) AS m, avg(v) FILTER (v > 0) AS pos, stddev_pop(v) FILTER (idx < k) AS sd FROM k GROUP BY 1, 2)
SELECT path, channel, n, k AS r0_window, {_s('CASE WHEN n >= k + 5 THEN sd / CASE WHEN m > 0 THEN m ELSE coalesce(pos, 1) END ELSE 0 END', 6)} AS noise_floor, false AS approximate FROM g""",
    "absolute_by_channel": f"""WITH {views.WAVE}, b AS (SELECT recording_id, any_value(n) AS n, median(v) FILTER (idx < least(30, greatest(5, floor(n * 0.15::DOUBLE)))) AS r0, avg(v) FILTER (idx >= n - 10 OR n < 10) AS raw FROM wave GROUP BY 1),
l AS (SELECT *, recording_id % 3 = 1 AS own, CASE WHEN recording_id % 3 = 1 THEN 1.5 ELSE {features.NOMINAL[0]} END::DOUBLE AS a, CASE WHEN recording_id % 3 = 1 THEN -0.8 ELSE {features.NOMINAL[1]} END::DOUBLE AS b FROM b)
SELECT recording_id, (recording_id % 3)::VARCHAR AS channel, CASE WHEN own THEN 'manifest' ELSE 'nominal-default' END AS calibration_source, {_s('CASE WHEN raw / r0 > 0 THEN pow(raw / r0 / greatest(a, 0.001::DOUBLE), 1 / b) ELSE 0 END', 5)} AS concentration FROM l""",
    "sensor_suggestions": f"""WITH sp AS (SELECT p_partkey, ['mq', 'MQ-', 'Mq_', 'mq '][p_size % 4 + 1] || ['2', '3', '135', '8', '99', '309a', '7'][p_partkey % 7 + 1] AS sensor FROM part), {_MODEL_KEYS},
k AS (SELECT *, regexp_replace(upper(sensor), '[^A-Z0-9]', '', 'g') AS k FROM sp), u AS (SELECT * FROM k WHERE k NOT IN (SELECT k FROM md)),
r AS (SELECT u.p_partkey, u.sensor, md.model, row_number() OVER (PARTITION BY u.p_partkey ORDER BY levenshtein(u.k, md.k), md.model) AS r FROM u, md)
SELECT p_partkey, sensor, string_agg(model, ',' ORDER BY r) AS close FROM r WHERE r <= 3 GROUP BY 1, 2""",
}
