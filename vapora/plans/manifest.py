"""Schemas of manifests and events, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNEL = "struct<id:string,unit:string,target:string>"
CALIBRATION = "struct<a:double,b:double,referenceSubstance:string,referencePpm:double,date:string,method:string>"
SENSOR = f"struct<sensorType:string,channels:array<{CHANNEL}>,device:struct<model:string,serial:string,firmware:string>,samplingRateHz:double,adcBits:int,adcMax:int,timeColumn:string,calibration:map<string,{CALIBRATION}>>"
SESSION = "struct<role:string,label:string,groupId:string,recordedAt:string,durationMs:bigint,notes:string>"
BASELINE = "struct<source:string,file:string,r0Samples:int>"
MANIFEST = f"struct<sensor:{SENSOR},session:{SESSION},baseline:{BASELINE}>"
EVENTS = "array<struct<label:string,startMs:bigint,endMs:bigint,note:string>>"
#: Top-level keys that the schema names; all others are kept as they are.
KNOWN = ("sensor", "session", "baseline")


def from_json(text: Column) -> Column:
    return F.from_json(text, MANIFEST)


def to_json(manifest: Column) -> Column:
    """JSON without the keys that are NULL."""
    return F.to_json(manifest)


def extra(text: Column) -> Column:
    """Top-level keys beyond the schema, each as its JSON."""
    keys = F.array_except(F.json_object_keys(text), F.array(*(F.lit(k) for k in KNOWN)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.from_json(text, "map<string,string>"), k)))


def at(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path with indexes, such as sensor.channels[0].id or ingest.context.Temperature, as a type; NULL where there is none, or no JSON."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{path}", kind)


def same(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same, whatever their spaces, the order of their keys and the form of their numbers.

    Numbers are compared as doubles, as 9.6E-4 and 0.00096 are one; whole numbers of more than 15 digits digit by digit.
    """
    word = r'"(?:[^"\\]++|\\.)*+"|[^",:\[\]{}]++|[,:\[\]{}]'
    number = lambda x: F.when(x.rlike(r"^-?[0-9]") & ~x.rlike(r"^-?[0-9]{16,}$"), x.try_cast("double").cast("string")).otherwise(x)
    plain = lambda text: F.array_join(F.transform(F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(word), F.lit(0)), number), "")
    return plain(a) == plain(b)


def shape(texts: DataFrame, column: str = "manifest") -> DataFrame:
    """One row: the schema that all JSON texts of a column share, open keys included."""
    return texts.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("shape"))


def build(recordings: DataFrame, label: Column | None = None, role: str = "single") -> DataFrame:
    """Readable recordings with a manifest that says where they come from.

    Channels of the sensor are declared as such; what was read beside them (the context's values among it), what was skipped and what
    the reader noticed is kept under ingest, a key that the schema doesn't name.
    """
    last = lambda t: F.when(F.size(t) > 1, F.element_at(t, -1) - F.element_at(t, 1)).otherwise(0.0)
    nothing = F.lit(None).cast("string")
    sensor = F.struct(F.col("sensor_type").alias("sensorType"), F.transform("channel_ids", lambda c: F.struct(c.alias("id"), F.lit("adc").alias("unit"))).alias("channels"), F.when(F.col("rate_hz") > 0, F.col("rate_hz")).alias("samplingRateHz"))
    session = F.struct(F.lit(role).alias("role"), (label if label is not None else F.element_at(F.split("path", "/"), -1)).alias("label"), F.col("substance").alias("groupId"), last(F.col("t")).cast("bigint").alias("durationMs"), F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).alias("notes"))
    ingest = F.struct(F.col("path").alias("sourceFile"), F.col("time_source").alias("timeSource"), F.col("context_ids").alias("contextColumns"), F.col("skipped").alias("skippedColumns"), "warnings", "context")
    made = F.to_json(F.struct(sensor.alias("sensor"), session.alias("session"), F.struct(F.lit("vapora").alias("importer")).alias("software"), ingest.alias("ingest")))
    return recordings.where("ok").withColumn("manifest", F.coalesce("manifest", made, nothing))


def declarations(recordings: DataFrame) -> DataFrame:
    """recordings with what their manifests declare for the quality score: rate, adc_max, role, baseline, r0_samples."""
    m = recordings.withColumn("_m", from_json("manifest"))
    return m.select(
        *recordings.columns, F.col("_m.sensor.samplingRateHz").alias("rate"), F.col("_m.sensor.adcMax").cast("double").alias("adc_max"), F.coalesce("_m.session.role", F.lit("single")).alias("role"),
        F.coalesce("_m.baseline.source", F.lit("none")).alias("baseline"), F.col("_m.baseline.r0Samples").alias("r0_samples"),
    )


def calibration_of(recordings: DataFrame) -> DataFrame:
    """path, channel, a and b of every calibrated channel; the nominal law is for those without."""
    return recordings.select("path", F.explode(from_json("manifest")["sensor"]["calibration"]).alias("channel", "c")).select("path", "channel", "c.a", "c.b")


def events_within(recordings: DataFrame, samples: DataFrame) -> DataFrame:
    """An extension: samples (recording_id, t_ms) with the event that spans them."""
    e = recordings.select(F.col("path").alias("recording_id"), F.inline(F.from_json("events", EVENTS)))
    s = samples.alias("s").join(e.alias("e"), "recording_id")
    return s.where("t_ms BETWEEN startMs AND coalesce(endMs, startMs)").drop("startMs", "endMs", "note")
