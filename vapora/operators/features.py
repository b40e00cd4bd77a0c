"""Feature framework of one channel, in closed form over its array.

Every function takes series (key columns, v, n) with k and r0 from baseline.r0_view_a and adds columns. sr is the sampling
rate in Hz. Spectrum and decay fit are in spectral.py and decay.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.operators.baseline import R0_WAVE, r0_legacy, r0_view_a
from vapora.plans import views

#: Nominal power law (a, b) of a channel without calibration.
NOMINAL = (1.0, -0.5)


def device_agnostic(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """Amplitude, direction, rise and decay time, area and endpoint; -1 throughout if the window leaves under 2 rows.

    A dead channel (deviation under a thousandth of r0) has amplitude, direction, area and endpoint 0 and no times.
    """
    s = series.withColumns({"short": F.expr("n < k + 2"), "std_ratio": F.expr(f"{A.std('f')} / r0")})
    s = s.withColumn("dead", F.expr("coalesce(size(f) < 2 OR std_ratio < 0.001D, true)"))
    s = s.withColumns({"hi": F.expr("array_max(v)"), "lo": F.expr("array_min(v)")})
    s = s.withColumn("dir", F.expr("CASE WHEN abs(hi - r0) >= abs(lo - r0) THEN 1 ELSE -1 END"))
    s = s.withColumn("reach", F.expr("abs(CASE WHEN dir > 0 THEN hi ELSE lo END - r0)"))
    s = s.withColumns({f"th{p}": F.expr(f"greatest(lo, least(hi, r0 + 0.{p // 10}D * reach * dir))") for p in (10, 90)})
    s = s.withColumns({f"i{p}": F.expr(A.first_where("v", f"CASE WHEN dir > 0 THEN x >= th{p} ELSE x <= th{p} END")) for p in (10, 90)})
    s = s.withColumn("peak", F.expr(A.first_largest("transform(v, x -> abs(x - r0))")))
    s = s.withColumn("post", F.expr("slice(v, cast(peak + 1 AS int), cast(n - peak AS int))"))
    back = lambda p: f"CASE WHEN dir > 0 THEN x <= th{p} ELSE x >= th{p} END"
    s = s.withColumn("si", F.expr(A.first_where("post", back(90))))
    s = s.withColumn("ei", F.expr(f"CASE WHEN si >= 0 THEN {A.first_where('slice(post, cast(si + 1 AS int), size(post))', back(10))} ELSE -1 END"))
    alive = lambda x, dead: f"CASE WHEN short THEN -1D WHEN dead THEN {dead} ELSE {x} END"
    s = s.withColumns({
        "relative_amplitude": F.expr(alive("reach / r0", "0D")),
        "direction": F.expr(alive("cast(dir AS double)", "0D")),
        "rise_time": F.expr(alive(f"CASE WHEN i10 >= 0 AND i90 >= 0 AND i10 < n - 1 AND i90 < n - 1 THEN abs(i90 - i10) / {sr}D ELSE -1D END", "-1D")),
        "decay_time": F.expr(alive(f"CASE WHEN size(post) > 2 AND si >= 0 AND ei >= 0 THEN (si + ei) / {sr}D ELSE -1D END", "-1D")),
        "auc": F.expr(alive(f"{A.trapezoid(A.absolute(A.relative('v', 'r0')))} / {sr}D", "0D")),
        "endpoint_delta": F.expr(alive("(element_at(v, -1) - r0) / r0", "0D")),
    })
    return s.withColumn("is_dead", F.expr("short OR dead")).drop("short", "dead", "hi", "lo", "dir", "reach", "th10", "th90", "i10", "i90", "post", "si", "ei")


def absolute(series: DataFrame, a: float = NOMINAL[0], b: float = NOMINAL[1]) -> DataFrame:
    """Mean of the last 10 rows, the baseline, and the concentration of the power law; 0 where that is undefined."""
    s = series.withColumn("raw_resistance", F.expr(A.mean("CASE WHEN n >= 10 THEN slice(v, -10, 10) ELSE v END")))
    conc = f"CASE WHEN raw_resistance / r0 > 0D THEN pow(raw_resistance / r0 / {max(a, 0.001)}D, {1 / b}D) ELSE 0D END" if b else "0D"
    return s.withColumns({"baseline_resistance": F.col("r0"), "voltage": F.col("raw_resistance"), "calibrated_concentration": F.expr(conc)})


def temporal(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """Mean absolute step per second, and the time of the first row from 10 on beyond 3 deviations of the first 10."""
    s = series.withColumns({"m10": F.expr(A.mean("CASE WHEN n >= 10 THEN slice(v, 1, 10) ELSE slice(v, 1, 1) END")), "s10": F.expr(f"3D * {A.std('CASE WHEN n >= 10 THEN slice(v, 1, 10) ELSE v END')}")})
    first = A.first_where("transform(v, (x, i) -> CASE WHEN i >= 10 THEN abs(x - m10) END)", "x > s10")
    s = s.withColumn("at", F.expr(first))
    return s.withColumns({
        "hf_transient": F.expr(f"CASE WHEN n < 5 THEN 0D ELSE {A.mean(A.absolute(A.steps('v')))} * {sr}D END"),
        "response_latency": F.expr(f"CASE WHEN n < 5 OR at < 0 THEN -1D ELSE at / {sr}D END"),
    }).drop("m10", "s10", "at")


def health(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """Drift per second, change from the first to the last third, noise of the baseline window, and hysteresis; 0 for short series."""
    s = series.withColumn("long", F.expr("n >= k + 5")).withColumn("pk", F.expr(A.first_largest("transform(v, x -> abs(x - r0))")))
    s = s.withColumn("dev", F.expr("transform(v, x -> abs(x - r0))")).withColumn("third", F.expr("cast(n div 3 AS int)"))
    s = s.withColumns({"ads": F.expr(A.trapezoid("slice(dev, 1, cast(pk + 1 AS int))")), "des": F.expr(A.trapezoid("slice(dev, cast(pk + 1 AS int), cast(n - pk AS int))")), "mean_all": F.expr(A.mean("v"))})
    xy = "aggregate(transform(v, (x, i) -> (i - (n - 1) / 2D) * (x - mean_all)), 0D, (a, x) -> a + x)"
    xx = "(cast(n AS double) * (cast(n AS double) * n - 1D) / 12D)"
    return s.withColumns({
        "drift_rate": F.expr(f"CASE WHEN long THEN {xy} / nullif({xx}, 0D) * {sr}D ELSE 0D END"),
        "sensitivity_decay": F.expr(f"CASE WHEN long AND third > 0 THEN ({A.mean('slice(v, cast(n AS int) - third + 1, third)')} - {A.mean('slice(v, 1, third)')}) / r0 ELSE 0D END"),
        "noise_floor": F.expr(f"CASE WHEN long THEN {A.std('slice(v, 1, k)')} / r0 ELSE 0D END"),
        "hysteresis": F.expr("CASE WHEN long AND pk > 5 AND pk < n - 5 THEN abs(ads - des) / greatest(ads, 1e-10D) ELSE 0D END"),
    }).drop("long", "pk", "dev", "third", "ads", "des", "mean_all")


def hardware(series: DataFrame) -> DataFrame:
    """Mean, deviation, and the deviation from a centred mean of 5; noise needs 10 rows, all need 2."""
    five = "(element_at(v, i) + element_at(v, i + 1) + element_at(v, i + 2) + element_at(v, i + 3) + element_at(v, i + 4)) / 5D"
    residual = f"transform(sequence(1, cast(n AS int) - 4), i -> element_at(v, i + 2) - {five})"
    return series.withColumns({
        "circuit_response": F.expr(f"CASE WHEN n < 2 THEN 0D ELSE {A.mean('v')} END"),
        "thermal_profile": F.expr(f"CASE WHEN n < 2 THEN 0D ELSE {A.std('v')} END"),
        "adc_noise": F.expr(f"CASE WHEN n < 10 THEN 0D ELSE {A.std(residual)} END"),
    })


def saturation(series: DataFrame) -> DataFrame:
    """Response against response plus ten times the noise; 0 for short series and for responses under twice the noise."""
    s = series.withColumn("rel", F.expr("transform(v, x -> abs(x - r0) / r0)")).withColumns({"resp": F.expr("array_max(rel)"), "nf": F.expr(A.std("slice(rel, 1, k)"))})
    return s.withColumn("saturation_index", F.expr("CASE WHEN n < k + 5 OR resp < nf * 2D OR resp + nf * 10D = 0D THEN 0D ELSE least(1D, resp / (resp + nf * 10D)) END")).drop("rel", "resp", "nf")


#: Features of a channel in the order of extraction, by block; the spectral and decay ones come from their own modules.
BLOCKS = {
    "advanced": ("saturation_index",),
    "da": ("relative_amplitude", "direction", "rise_time", "decay_time", "auc", "endpoint_delta"),
    "abs": ("raw_resistance", "baseline_resistance", "voltage", "calibrated_concentration"),
    "temp": ("hf_transient", "oscillation_freq", "oscillation_amp", "response_latency"),
    "health": ("drift_rate", "sensitivity_decay", "noise_floor", "hysteresis"),
    "hw": ("circuit_response", "thermal_profile", "adc_noise"),
    "decay": ("tau1", "tau2", "tau3", "a1", "a2", "a3"),
}
CLOSED = [f for b in ("advanced", "da", "abs", "temp", "health", "hw") for f in BLOCKS[b] if not f.startswith("oscillation")]


def closed_form(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """All closed-form features of series (keys, v, n)."""
    return saturation(hardware(health(temporal(absolute(device_agnostic(r0_view_a(series), sr)), sr), sr)))


def feature_names(channels: int) -> list[str]:
    """Names in the order of extraction: 28 per channel, a ratio per pair, 4 global ones."""
    names = [f"ch{c}_{b}_{f}" for c in range(channels) for b, fs in BLOCKS.items() for f in fs]
    names += [f"sel_ratio_ch{i}_ch{j}" for i in range(channels) for j in range(i + 1, channels)]
    return [*names, "global_max_delta_ratio", "global_mean_delta_ratio", "global_n_active_channels", "global_total_auc"]


def selectivity(channels: DataFrame) -> DataFrame:
    """Amplitude ratio of each pair of a recording's channels (recording_id, channel, relative_amplitude, is_dead); 0 unless both respond."""
    a = channels.select("recording_id", F.col("channel").alias("channel_i"), F.col("relative_amplitude").alias("amp_i"), F.col("is_dead").alias("dead_i"))
    b = channels.select("recording_id", F.col("channel").alias("channel_j"), F.col("relative_amplitude").alias("amp_j"), F.col("is_dead").alias("dead_j"))
    both = a.join(b, "recording_id").where("channel_i < channel_j")
    return both.select("recording_id", "channel_i", "channel_j", F.expr("CASE WHEN NOT dead_i AND NOT dead_j AND amp_i > 0D AND amp_j > 0D THEN amp_i / amp_j ELSE 0D END").alias("sel_ratio"))


def global_features(channels: DataFrame) -> DataFrame:
    """Largest and mean amplitude, count and total area of a recording's channels that aren't dead."""
    live = F.expr("NOT is_dead")
    return channels.groupBy("recording_id").agg(
        F.coalesce(F.max(F.when(live, F.col("relative_amplitude"))), F.lit(0.0)).alias("global_max_delta_ratio"),
        F.coalesce(F.avg(F.when(live, F.col("relative_amplitude"))), F.lit(0.0)).alias("global_mean_delta_ratio"),
        F.count_if(live).alias("global_n_active_channels"),
        F.coalesce(F.sum(F.when(live, F.col("auc"))), F.lit(0.0)).alias("global_total_auc"),
    )


def r0_legacy_normalised(series: DataFrame) -> DataFrame:
    """series with values relative to the legacy baseline, without times."""
    s = r0_legacy(series)
    return s.withColumn("v", F.expr(A.relative("v", "r0"))).select([c for c in series.columns if c != "t"])


def _rounded(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    return df.selectExpr(*keys, *(f"{A.snap(c, digits)} AS {c}" for c in columns))


def _q_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = device_agnostic(r0_view_a(views.wave(spark, sf_dir)))
    return _rounded(out, ["recording_id", "cast(direction AS int) AS direction", "cast(peak AS int) AS peak_idx", "is_dead"], ["r0", "relative_amplitude"])


def _q_rise_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(device_agnostic(r0_view_a(views.wave(spark, sf_dir))), ["recording_id"], ["rise_time", "decay_time"])


def _q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(device_agnostic(r0_view_a(views.wave(spark, sf_dir))), ["recording_id"], ["auc", "endpoint_delta"])


def _q_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(absolute(r0_view_a(views.wave(spark, sf_dir))), ["recording_id"], ["raw_resistance", "baseline_resistance", "voltage", "calibrated_concentration"])


def _q_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(temporal(views.wave(spark, sf_dir)), ["recording_id"], ["hf_transient", "response_latency"])


def _q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health(r0_view_a(views.wave(spark, sf_dir))), ["recording_id"], ["drift_rate", "sensitivity_decay", "noise_floor", "hysteresis"])


def _q_hardware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hardware(views.wave(spark, sf_dir)), ["recording_id"], ["circuit_response", "thermal_profile", "adc_noise"])


def _q_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(saturation(r0_view_a(views.wave(spark, sf_dir))), ["recording_id"], ["saturation_index"])


def _stream_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_agnostic(r0_view_a(views.stream(spark, sf_dir))).select("recording_id", "channel", "relative_amplitude", "auc", "is_dead")


def _q_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selectivity(_stream_channels(spark, sf_dir)), ["recording_id", "channel_i", "channel_j"], ["sel_ratio"])


def _q_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(global_features(_stream_channels(spark, sf_dir)), ["recording_id", "global_n_active_channels"], ["global_max_delta_ratio", "global_mean_delta_ratio", "global_total_auc"])


QUERIES = {
    "relative_amplitude_direction": _q_relative,
    "rise_decay_times": _q_rise_decay,
    "auc_endpoint": _q_auc,
    "absolute_features": _q_absolute,
    "temporal_closed_form": _q_temporal,
    "health_features": _q_health,
    "hardware_features": _q_hardware,
    "saturation_index": _q_saturation,
    "selectivity_pairs": _q_selectivity,
    "global_features": _q_global,
}


def _agnostic(rows: str, keys: str, sr: float = 10.0) -> str:
    """CTEs from rows (keys, idx, v, n) to one row per key with the device-agnostic features."""
    k = "least(30, greatest(5, floor(n * 0.15::DOUBLE)))::INT"
    on = f"USING ({keys})"
    return f"""
b AS (SELECT {keys}, any_value(n) AS n, any_value({k}) AS k, median(v) FILTER (idx < {k}) AS m, avg(v) FILTER (v > 0) AS pos, max(v) AS hi, min(v) AS lo, stddev_pop(v) AS sd, arg_max(v, idx) AS last_v FROM {rows} GROUP BY {keys}),
c AS (SELECT *, CASE WHEN m > 0 THEN m ELSE coalesce(pos, 1) END AS r0 FROM b),
d AS (SELECT *, CASE WHEN abs(hi - r0) >= abs(lo - r0) THEN 1 ELSE -1 END AS dir, n < 2 OR sd / r0 < 0.001 AS dead FROM c),
e AS (SELECT *, abs(CASE WHEN dir > 0 THEN hi ELSE lo END - r0) AS reach FROM d),
th AS (SELECT *, greatest(lo, least(hi, r0 + 0.1::DOUBLE * reach * dir)) AS th10, greatest(lo, least(hi, r0 + 0.9::DOUBLE * reach * dir)) AS th90 FROM e),
i AS (SELECT {keys}, min(idx) FILTER (CASE WHEN dir > 0 THEN v >= th10 ELSE v <= th10 END) AS i10, min(idx) FILTER (CASE WHEN dir > 0 THEN v >= th90 ELSE v <= th90 END) AS i90, arg_min(idx, (-abs(v - r0), idx)) AS peak,
  list(abs((v - r0) / r0) ORDER BY idx) AS dev FROM {rows} JOIN th {on.replace('USING (', 'USING (')} GROUP BY {keys}),
s AS (SELECT {keys}, min(idx) FILTER (idx >= peak AND CASE WHEN dir > 0 THEN v <= th90 ELSE v >= th90 END) AS si FROM (SELECT {keys}, idx, v FROM {rows}) JOIN th {on} JOIN i {on} GROUP BY {keys}),
x AS (SELECT {keys}, min(idx) FILTER (idx >= si AND CASE WHEN dir > 0 THEN v <= th10 ELSE v >= th10 END) AS ei FROM (SELECT {keys}, idx, v FROM {rows}) JOIN th {on} JOIN s {on} GROUP BY {keys}),
da AS (SELECT {keys}, n, k, r0, peak, n < k + 2 OR dead AS is_dead,
  CASE WHEN n < k + 2 THEN -1 WHEN dead THEN 0 ELSE reach / r0 END AS relative_amplitude, CASE WHEN n < k + 2 THEN -1 WHEN dead THEN 0 ELSE dir END AS direction,
  CASE WHEN n < k + 2 OR dead OR i10 IS NULL OR i90 IS NULL OR i10 >= n - 1 OR i90 >= n - 1 THEN -1 ELSE abs(i90 - i10) / {sr}::DOUBLE END AS rise_time,
  CASE WHEN n < k + 2 OR dead OR n - peak <= 2 OR si IS NULL OR ei IS NULL THEN -1 ELSE (ei - peak) / {sr}::DOUBLE END AS decay_time,
  CASE WHEN n < k + 2 THEN -1 WHEN dead THEN 0 ELSE (list_sum(dev) - (dev[1] + dev[len(dev)]) / 2) / {sr}::DOUBLE END AS auc,
  CASE WHEN n < k + 2 THEN -1 WHEN dead THEN 0 ELSE (last_v - r0) / r0 END AS endpoint_delta
  FROM th JOIN i {on} JOIN s {on} JOIN x {on})"""


_WAVE_DA = f"WITH {views.WAVE}, {_agnostic('wave', 'recording_id')}"
_STREAM_DA = f"WITH {views.STREAM}, {_agnostic('stream', 'recording_id, channel')}"
_s = A.snap
ORACLE_SQL = {
    "relative_amplitude_direction": f"{_WAVE_DA} SELECT recording_id, direction::INT AS direction, peak::INT AS peak_idx, is_dead, {_s('r0', 6)} AS r0, {_s('relative_amplitude', 6)} AS relative_amplitude FROM da",
    "rise_decay_times": f"{_WAVE_DA} SELECT recording_id, {_s('rise_time', 6)} AS rise_time, {_s('decay_time', 6)} AS decay_time FROM da",
    "auc_endpoint": f"{_WAVE_DA} SELECT recording_id, {_s('auc', 6)} AS auc, {_s('endpoint_delta', 6)} AS endpoint_delta FROM da",
    "absolute_features": f"""WITH {views.WAVE}, {R0_WAVE}, l AS (SELECT recording_id, avg(v) FILTER (idx >= n - 10) AS raw FROM wave GROUP BY recording_id)
SELECT recording_id, {_s('raw', 6)} AS raw_resistance, {_s('r0', 6)} AS baseline_resistance, {_s('raw', 6)} AS voltage, {_s('CASE WHEN raw / r0 > 0 THEN pow(raw / r0, -2) ELSE 0 END', 6)} AS calibrated_concentration FROM l JOIN r0 USING (recording_id)""",
    "temporal_closed_form": f"""WITH {views.WAVE}, d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY recording_id ORDER BY idx)) AS step FROM wave),
m AS (SELECT recording_id, avg(v) FILTER (idx < 10) AS m, stddev_pop(v) FILTER (idx < 10) * 3 AS s, avg(step) AS step FROM d GROUP BY recording_id),
f AS (SELECT recording_id, min(idx) FILTER (idx >= 10 AND abs(v - m) > s) AS hit FROM wave JOIN m USING (recording_id) GROUP BY recording_id)
SELECT recording_id, {_s('step * 10', 6)} AS hf_transient, {_s('coalesce(hit / 10::DOUBLE, -1)', 6)} AS response_latency FROM m JOIN f USING (recording_id)""",
    "health_features": f"""WITH {views.WAVE}, {R0_WAVE}, j AS (SELECT wave.*, r0, k, abs(v - r0) AS dev FROM wave JOIN r0 USING (recording_id)),
p AS (SELECT recording_id, arg_min(idx, (-dev, idx)) AS pk, regr_slope(v, idx) * 10 AS drift, avg(v) FILTER (idx < n // 3) AS first_mean, avg(v) FILTER (idx >= n - n // 3) AS last_mean, stddev_pop(v) FILTER (idx < k) AS s, any_value(r0) AS r0, any_value(n) AS n FROM j GROUP BY recording_id),
t AS (SELECT *, lead(dev) OVER (PARTITION BY recording_id ORDER BY idx) AS after FROM j),
h AS (SELECT recording_id, sum((dev + after) / 2) FILTER (idx < pk) AS ads, sum((dev + after) / 2) FILTER (idx >= pk) AS des FROM t JOIN p USING (recording_id) GROUP BY recording_id)
SELECT recording_id, {_s('drift', 6)} AS drift_rate, {_s('(last_mean - first_mean) / r0', 6)} AS sensitivity_decay, {_s('s / r0', 6)} AS noise_floor, {_s('CASE WHEN pk > 5 AND pk < n - 5 THEN abs(ads - des) / greatest(ads, 1e-10) ELSE 0 END', 6)} AS hysteresis FROM p JOIN h USING (recording_id)""",
    "hardware_features": f"""WITH {views.WAVE}, a AS (SELECT *, v - avg(v) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS res FROM wave)
SELECT recording_id, {_s('avg(v)', 6)} AS circuit_response, {_s('stddev_pop(v)', 6)} AS thermal_profile, {_s('stddev_pop(res) FILTER (idx BETWEEN 2 AND n - 3)', 6)} AS adc_noise FROM a GROUP BY recording_id""",
    "saturation_index": f"""WITH {views.WAVE}, {R0_WAVE}, j AS (SELECT wave.recording_id, idx, k, abs(v - r0) / r0 AS rel FROM wave JOIN r0 USING (recording_id)),
g AS (SELECT recording_id, max(rel) AS resp, stddev_pop(rel) FILTER (idx < k) AS nf FROM j GROUP BY recording_id)
SELECT recording_id, {_s('CASE WHEN resp < nf * 2 THEN 0 ELSE least(1, resp / (resp + nf * 10)) END', 6)} AS saturation_index FROM g""",
    "selectivity_pairs": f"{_STREAM_DA} SELECT a.recording_id, a.channel AS channel_i, b.channel AS channel_j, {_s('CASE WHEN NOT a.is_dead AND NOT b.is_dead AND a.relative_amplitude > 0 AND b.relative_amplitude > 0 THEN a.relative_amplitude / b.relative_amplitude ELSE 0 END', 6)} AS sel_ratio FROM da a JOIN da b ON a.recording_id = b.recording_id AND a.channel < b.channel",
    "global_features": f"{_STREAM_DA} SELECT recording_id, count(*) FILTER (NOT is_dead) AS global_n_active_channels, {_s('coalesce(max(relative_amplitude) FILTER (NOT is_dead), 0)', 6)} AS global_max_delta_ratio, {_s('coalesce(avg(relative_amplitude) FILTER (NOT is_dead), 0)', 6)} AS global_mean_delta_ratio, {_s('coalesce(sum(auc) FILTER (NOT is_dead), 0)', 6)} AS global_total_auc FROM da GROUP BY recording_id",
}
