"""Recording-shaped views of the driver's tables: recording_id, channel, t (ms), v and n, one row per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import catalogue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as substances: p_partkey and the compound of the catalogue that its key chooses."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", f"cast(p_partkey % {len(catalogue.compound_rows())} AS int) AS ord")
    return parts.join(F.broadcast(catalogue.compounds(spark)), "ord")


def gather(samples: DataFrame, *keys: str) -> DataFrame:
    """Long samples (keys, t, tie, value) as one row per channel in time order."""
    rows = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "tie", "value"))).alias("s"))
    return rows.select(*keys, F.expr("transform(s, x -> x.t)").alias("t"), F.expr("transform(s, x -> x.value)").alias("v"), F.expr("cast(size(s) AS long)").alias("n"))


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recordings at 10 Hz: value 1000 * (1 + component)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("recording_id"), F.expr("transform(sequence(0, size(embedding) - 1), i -> i * 100D)").alias("t"), F.expr("transform(embedding, x -> 1000D * (1D + cast(x AS double)))").alias("v"), F.expr("cast(size(embedding) AS long)").alias("n"))


def stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("event_id").alias("tie"), "value")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as irregular recordings: a channel per type and user."""
    return gather(stream_samples(spark, sf_dir), "recording_id", "channel")


def longrun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier by ship date as one long recording."""
    i = table(spark, sf_dir, "lineitem")
    rows = i.select(F.col("l_suppkey").alias("recording_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("double").alias("t"), F.struct("l_orderkey", "l_linenumber").alias("tie"), F.col("l_extendedprice").alias("value"))
    return gather(rows, "recording_id")


#: The same views for the oracle; of samples one row each with its place from 0.
PARTS = "pt AS (SELECT p_partkey, ids.id FROM part JOIN (VALUES " + ", ".join(f"({k}, '{r[1]}')" for k, r in enumerate(catalogue.compound_rows())) + f") ids(ord, id) ON p_partkey % {len(catalogue.compound_rows())} = ord)"
WAVE = "wave AS (SELECT vec_id AS recording_id, unnest(generate_series(0, len(embedding) - 1)) AS idx, 1000::DOUBLE * (1::DOUBLE + unnest(embedding)::DOUBLE) AS v, len(embedding) AS n FROM embeddings)"
STREAM = "stream AS (SELECT user_id AS recording_id, event_type AS channel, (epoch_us(ts) // 1000)::DOUBLE AS t, value AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)"
LONGRUN = "longrun AS (SELECT l_suppkey AS recording_id, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"
