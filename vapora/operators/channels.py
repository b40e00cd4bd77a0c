"""Selection, order and expansion of channels; sensor families; groups of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.operators import features, kinetics
from vapora.operators.presets import GROUP_MARKERS
from vapora.plans import views

#: The canonical order of channels.
CANONICAL = ("NO2", "C2H5OH", "VOC", "CO", "Alcohol", "LPG")


class UnsupportedSensorTypeError(ValueError):
    """Features of this sensor family aren't computed."""


def canonical_order(channels: Sequence[str]) -> list[str]:
    """Channels of the canonical array first, in its order, then the others in theirs."""
    return [c for c in CANONICAL if c in channels] + [c for c in channels if c not in CANONICAL]


def select_channels(samples: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """samples of the wanted channels with ch_idx in their order; a name that no recording has raises."""
    have = {r.channel for r in samples.select("channel").distinct().collect()}
    if missing := [c for c in wanted if c not in have]:
        raise ValueError(f"channels {missing} are missing")
    place = F.create_map(*(F.lit(x) for k, c in enumerate(wanted) for x in (c, k)))
    return samples.where(F.col("channel").isin(*wanted)).withColumn("ch_idx", F.element_at(place, F.col("channel")))


def expand_channels(series: DataFrame, targets: int, mapping: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """series (recording_id, ch_idx, v) with exactly `targets` channels: sources at their mapped places, zeros elsewhere."""
    moved = series
    if mapping is not None:
        pairs = series.sparkSession.createDataFrame([(int(a), int(b)) for a, b in mapping], "ch_idx int, to int")
        moved = series.join(F.broadcast(pairs), "ch_idx").withColumn("ch_idx", F.col("to")).drop("to")
    longest = series.groupBy("recording_id").agg(F.max(F.size("v")).alias("len"))
    spine = longest.select("recording_id", "len", F.explode(F.sequence(F.lit(0), F.lit(targets - 1))).alias("ch_idx"))
    out = spine.join(moved.select("recording_id", "ch_idx", "v"), ["recording_id", "ch_idx"], "left")
    return out.select("recording_id", "ch_idx", F.coalesce("v", F.expr("array_repeat(0D, len)")).alias("v"))


def feature_family(sensor_type: Column) -> Column:
    return F.when(sensor_type == "mox", "mox").when(sensor_type.isin("miris", "electrochemical"), "unsupported").otherwise("mox-compatible")


def run_processor(series: DataFrame, strict: bool = False) -> DataFrame:
    """Kinetic features of series (with sensor_type); rows of families without a backend get an error, or raise when strict."""
    family = feature_family(F.col("sensor_type"))
    bad = series.where(family == "unsupported")
    if strict and not bad.isEmpty():
        raise UnsupportedSensorTypeError(f"no features for sensor type {bad.first()['sensor_type']}")
    done = kinetics.kinetics(series.where(family != "unsupported")).withColumn("error", F.lit(None).cast("string"))
    missing = bad.withColumn("error", F.concat(F.lit("unsupported sensor type "), "sensor_type"))
    return done.unionByName(missing, allowMissingColumns=True)


def of_groups(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows (feature, value) of the named feature groups."""
    hit = F.lit(False)
    for g in groups:
        hit = hit | F.contains("feature", F.lit(GROUP_MARKERS[g]))
    return long.where(hit)


def legacy_vector(long: DataFrame, *keys: str) -> DataFrame:
    """A recording's feature values as one vector in the order of the sorted names, with the names in that order."""
    g = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"))
    return g.select(*keys, F.transform("f", lambda x: x["feature"]).alias("names"), F.transform("f", lambda x: x["value"].cast("float")).alias("vector"))


def framework(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """Long rows (recording_id, feature, value) of multi-channel recordings (recording_id, ch_idx, channel, v, n): per channel, per pair, global."""
    from vapora.operators.signal import spectrum_and_decay

    f = features.closed_form(series, sr)
    columns = [x for b, fs in features.BLOCKS.items() if b != "decay" for x in fs if not x.startswith("oscillation")]
    wide = f.select("recording_id", "ch_idx", "is_dead", "r0", "v", *columns)
    both = spectrum_and_decay(wide, sr).drop("r0", "cost")
    block = {x: b for b, fs in features.BLOCKS.items() for x in fs}
    per = both.unpivot(["recording_id", "ch_idx"], [x for fs in features.BLOCKS.values() for x in fs], "name", "value")
    names = F.create_map(*(F.lit(x) for k, b in block.items() for x in (k, b)))
    per = per.select("recording_id", F.concat(F.lit("ch"), "ch_idx", F.lit("_"), F.element_at(names, F.col("name")), F.lit("_"), "name").alias("feature"), "value")
    amp = wide.select("recording_id", F.col("ch_idx").alias("channel"), "relative_amplitude", "auc", "is_dead")
    pairs = features.selectivity(amp).select("recording_id", F.concat(F.lit("sel_ratio_ch"), "channel_i", F.lit("_ch"), "channel_j").alias("feature"), F.col("sel_ratio").alias("value"))
    total = features.global_features(amp).withColumn("global_n_active_channels", F.col("global_n_active_channels").cast("double"))
    every = total.unpivot(["recording_id"], [c for c in total.columns if c != "recording_id"], "feature", "value")
    return per.unionByName(pairs).unionByName(every)


def rank_channels(long: DataFrame, top: int = 3) -> DataFrame:
    """The channels of each recording with the largest amplitude."""
    w = Window.partitionBy("recording_id").orderBy(F.desc("relative_amplitude"), "channel")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _q_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir).selectExpr("recording_id div 4 AS recording_id", "cast(recording_id % 4 AS int) AS ch_idx", "v")
    out = expand_channels(w, 6, [(0, 5), (1, 0), (2, 2)])
    return out.selectExpr("recording_id", "ch_idx", "posexplode(v) AS (idx, value)").selectExpr("recording_id", "ch_idx", "idx", f"{A.snap('value', 4)} AS value")


def _q_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir).selectExpr("recording_id div 4 AS recording_id", "cast(recording_id % 4 AS int) AS ch_idx", "cast(recording_id % 4 AS string) AS channel", "v", "n")
    return framework(w)


QUERIES = {"expand_channels": _q_expand, "framework_features": _q_framework}
ORACLE_SQL = {
    "expand_channels": f"""WITH {views.WAVE}, m AS (SELECT recording_id // 4 AS recording_id, CASE recording_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS ch, idx, v FROM wave),
g AS (SELECT recording_id, c, i FROM (SELECT recording_id, unnest(range(max(idx) + 1)) AS i FROM m GROUP BY recording_id), range(6) r(c))
SELECT g.recording_id, c::INT AS ch_idx, i::INT AS idx, {A.snap('coalesce(v, 0)', 4)} AS value FROM g LEFT JOIN m ON m.recording_id = g.recording_id AND m.ch = c AND m.idx = i""",
}
