"""Byte ranges of large texts."""

from vapora.sources import files


def test_ranges_grow_with_the_file(tmp_path):
    (tmp_path / "a.csv").write_text("time,v\n" + "".join(f"{k},{k}\n" for k in range(100_000)))
    size = (tmp_path / "a.csv").stat().st_size
    pieces = [p for s in files.Reader({"path": str(tmp_path), "splitbytes": "1024"}).partitions() for p in s.pieces]
    assert 1 < len(pieces) <= files.RANGES < size // 1024
    assert [p[1] for p in pieces] == [0, *(p[2] for p in pieces[:-1])] and pieces[-1][2] == size


def test_texts_are_written_by_batches(spark, tmp_path):
    rows = spark.range(5000).selectExpr("concat('k', id div 3000, '/all.csv') AS path", "concat('é', id) AS line").coalesce(1)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        files.write_files(rows, str(tmp_path / "out"), overwrite=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (tmp_path / "out/k0/all.csv").read_text().splitlines() == [f"é{k}" for k in range(3000)]
    assert (tmp_path / "out/k1/all.csv").read_text().splitlines() == [f"é{k}" for k in range(3000, 5000)]
