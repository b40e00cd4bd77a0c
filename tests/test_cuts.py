"""Segments of long recordings."""

from pyspark.sql import functions as F

from vapora.operators import segments


def test_segments_keep_their_size_in_longer_recordings(spark, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT", 100)
    s = spark.range(20_000).selectExpr("1 AS k", "cast(id * 7919 % 20000 AS double) AS t", "id AS tie", "cast(id AS double) AS value")
    most = segments.cut(s, ["k"], rows=500, ranges=32).groupBy("k", "seg").count().agg(F.max("count")).first()[0]
    assert most <= 200
    p = segments.placed(s, ["k"], rows=500, ranges=32)
    assert p.where("idx <> t OR n <> 20000 OR idx > 0 AND prev_t <> t - 1").count() == 0 and p.count() == 20_000
