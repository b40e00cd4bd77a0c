"""An extension beyond finished recordings: samples scored as they arrive, with late ones bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(samples: DataFrame, late: str = "10 minutes", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Statistics of streaming samples (recording_id, channel, ts, value) per event-time window."""
    over = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = samples.withWatermark("ts", late).groupBy("recording_id", "channel", over)
    return g.agg(F.count("*").alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"), F.stddev_pop("value").alias("v_std"))


def sessions(samples: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Recordings split where no sample came for a while."""
    g = samples.withWatermark("ts", late).groupBy("recording_id", F.session_window("ts", gap).alias("session"))
    return g.agg(F.count("*").alias("n"), F.approx_count_distinct("channel").alias("channels"))
