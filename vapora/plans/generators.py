"""Synthetic recordings: the exposure envelope, quality cases, and a corpus with injected defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("VOC", "Alcohol", "LPG", "CO", "NO2", "C2H5OH")
DEFECTS = ("none", "gaps", "dead_channel", "saturation", "short", "baseline_contamination", "noise_burst")
#: Phases of a stress recording in seconds, at 1 Hz.
CLEAN_S, RISE_S, REST_S = 30, 45, 120


#: The cases of the quality score by what they change: name | rows | role | baseline | amplitude | recovers | rate | adc_max | late rows | dead channel.
CASES = """
ideal_exposure_auto           | 600 | exposure | auto | 600  | yes | 10 | 4095 | no  |
ideal_exposure_auto_no_adcmax | 600 | exposure | auto | 600  | yes | 10 |      | no  |
ideal_exposure_auto_no_rate   | 600 | exposure | auto | 600  | yes |    | 4095 | no  |
ideal_exposure_auto_undeclared| 600 | exposure | auto | 600  | yes |    |      | no  |
no_baseline                   | 600 | exposure | none | 600  | yes | 10 | 4095 | no  |
single_role                   | 600 | single   | auto | 600  | yes | 10 | 4095 | no  |
short_exposure                | 150 | exposure | auto | 600  | yes | 10 | 4095 | no  |
clipped_signal                | 600 | exposure | auto | 4100 | yes | 10 | 4095 | no  |
dead_channel                  | 600 | exposure | auto | 600  | yes | 10 | 4095 | no  | NO2
no_recovery                   | 600 | exposure | auto | 600  | no  | 10 | 4095 | no  |
low_span                      | 600 | exposure | auto | 40   | yes | 10 | 4095 | no  |
irregular_gaps                | 600 | exposure | auto | 600  | yes | 10 | 4095 | yes |
"""


def envelope(at: Column) -> Column:
    """Share of the amplitude at a share of the recording: clean to 15 %, rising to 45 %, level to 55 %, back to 0 at 90 %."""
    return F.when(at < 0.15, 0.0).when(at < 0.45, (at - 0.15) / 0.3).when(at < 0.55, 1.0).when(at < 0.9, (0.9 - at) / 0.35).otherwise(0.0)


def quality_cases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The twelve cases as channels (recording_id, channel, v, n) and as recordings (recording_id, t, n, declarations), for quality()."""
    number = lambda x, kind: kind(x) if x else None
    rows = [[c.strip() for c in line.split("|")] for line in CASES.strip().splitlines()]
    made = [(i, int(n), role, base, float(amp), back == "yes", number(rate, float), number(adc, float), late == "yes", dead or None) for i, n, role, base, amp, back, rate, adc, late, dead in rows]
    c = spark.createDataFrame(made, "recording_id string, n long, role string, baseline string, amp double, recovers boolean, rate double, adc_max double, late boolean, dead string")
    places = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    times = F.transform(places, lambda i: i * 100.0 + F.when(F.col("late") & (i % 8 == 0), 100.0).otherwise(0.0))
    recordings = c.select("recording_id", times.alias("t"), "n", "rate", F.lit(10.0).alias("guess_rate"), "adc_max", "role", "baseline", F.lit(15).alias("r0_samples"))
    channels = c.select("*", F.posexplode(F.array(*(F.lit(x) for x in CHANNELS))).alias("ch_idx", "channel"))
    shape = lambda i: F.when(~F.col("recovers") & (i / F.col("n") >= 0.55), 1.0).otherwise(envelope(i / F.col("n")))
    v = F.transform(places, lambda i: F.when(F.col("dead").eqNullSafe(F.col("channel")), 100.0).otherwise(100.0 + 30.0 * F.col("ch_idx") + F.col("amp") * shape(i)))
    return channels.select("recording_id", "channel", v.alias("v"), "n"), recordings


def exposure_samples(spark: SparkSession, recordings: int, n: int = 600, rate_hz: float = 10.0, amp: float = 600.0, dead: str | None = None) -> DataFrame:
    """Long samples of clean exposures on the canonical channels: recording_id, channel, ch_idx, idx, t_ms, value."""
    rows = spark.range(recordings).select(F.col("id").alias("recording_id"), F.posexplode(F.array(*(F.lit(c) for c in CHANNELS))).alias("ch_idx", "channel"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = F.lit(100.0) + 30.0 * F.col("ch_idx") + amp * envelope(F.col("idx") / n)
    return rows.select("recording_id", "channel", "ch_idx", "idx", (F.col("idx") * (1000.0 / rate_hz)).alias("t_ms"), (F.when(F.col("channel") == dead, 100.0).otherwise(value) if dead else value).alias("value"))


def stress_corpus(spark: SparkSession, recordings: int, seed: int = 1) -> DataFrame:
    """Recordings at 1 Hz in every defect: recording_id, defect, channel, idx, t_ms, value. The same seed gives the same rows."""
    u = lambda *k: F.pmod(F.xxhash64(*(F.lit(x) if isinstance(x, (int, str)) else x for x in k)), F.lit(1_000_003)) / 1_000_003.0
    r = spark.range(recordings).select(F.col("id").alias("recording_id"), F.explode(F.array(*(F.lit(d) for d in DEFECTS))).alias("defect"), F.explode(F.array(*(F.lit(c) for c in CHANNELS))).alias("channel"))
    r = r.withColumns({"level": 120 + 280 * u(F.col("recording_id"), F.col("channel"), seed, "level"), "amp": 60 + 540 * u(F.col("recording_id"), F.col("channel"), seed, "amp"), "tau": 5 + 15 * u(F.col("recording_id"), F.col("channel"), seed, "tau")})
    r = r.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(CLEAN_S + RISE_S + REST_S - 1))))
    up, back = F.col("idx") - CLEAN_S, F.col("idx") - CLEAN_S - RISE_S
    shape = F.when(up < 0, 0.0).when(back < 0, 1 - F.exp(-up / F.col("tau"))).otherwise((1 - F.exp(-RISE_S / F.col("tau"))) * F.exp(-back / (2 * F.col("tau"))))
    noise = 2 * (u(F.col("recording_id"), F.col("channel"), F.col("idx"), seed, "noise") - 0.5)
    r = r.withColumn("value", F.col("level") + F.col("amp") * shape + noise)
    burst = 120 * (u(F.col("recording_id"), F.col("idx"), seed, "burst") - 0.5)
    value = (
        F.when((F.col("defect") == "dead_channel") & (F.col("channel") == "NO2"), F.col("level")).when((F.col("defect") == "saturation") & F.col("idx").between(50, 90), 4095.0)
        .when((F.col("defect") == "baseline_contamination") & (F.col("idx") < CLEAN_S), F.col("value") + 0.3 * F.col("amp") * F.col("idx") / CLEAN_S)
        .when((F.col("defect") == "noise_burst") & F.col("idx").between(100, 130), F.col("value") + burst).otherwise(F.col("value"))
    )
    r = r.withColumns({"value": value, "t_ms": F.col("idx") * 1000.0 + F.when((F.col("defect") == "gaps") & (F.col("idx") % 7 == 0), 400.0).otherwise(0.0)})
    return r.where("defect <> 'short' OR idx < 40").select("recording_id", "defect", "channel", "idx", "t_ms", "value")
