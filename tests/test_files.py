"""The data source of recording files: byte ranges against whole files, pushed conditions, commits and aborts."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

from vapora.sources import files
from vapora.sources import recordings as R

DIALECTS = {
    "plain": "# made\ntimestamp_ms,VOC,CO,note\n" + "".join(f"{k * 100},{k / 4},{'n/a' if k % 7 == 3 else k},x\n" for k in range(200)),
    "semicolons": "﻿\n\nTime (s);VOC;Temperature;VOC\n" + "\n# between\n".join(f"{200 - k};{k}_0;20;7" for k in range(90)),
    "synthetic": 'VOC,"a ""b"", c",none\n' + "\n".join(f'{k},"{k}",-' for k in range(60)) + "\n1,2\n3,4,x,6\nlast,1,-",
    "epoch": "timestamp,VOC\n" + "".join(f"{1_700_000_000 + k},{k}\n" for k in range(50)) + "7,1\n",
    "broken times": "time,VOC\r\n" + "".join(f"{'soon' if k < 25 else k},{k}\r\n" for k in range(40)),
    "some times": "time,VOC\n" + "".join(f"{'soon' if k % 5 else k},{k}\n" for k in range(40)),
    "tabs, one sample": "elapsed\tVOC\n5\t1",
    "long comment": "#" + "c" * 200_000 + "\n\n" + "time,VOC\n1,2\n2,3\n",
}
BAD = {"empty": "", "comments alone": "# a\n# b\n", "header alone": "time,VOC\n"}


def lay_out(folder, texts):
    for name, text in texts.items():
        os.makedirs(folder / name, exist_ok=True)
        (folder / name / "r.csv").write_bytes(text.encode())


@pytest.mark.parametrize("split", [150, 90_000, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, split):
    texts = {n: t for n, t in DIALECTS.items() if len(t) < 300 * split}
    lay_out(tmp_path, texts | BAD)
    lines = files.read_lines(spark, str(tmp_path), splitBytes=split)
    got, ids = {}, {r.path: r for r in files.channel_table(lines).collect()}
    for r in files.samples(lines).collect():
        got.setdefault(r.path, []).append(r)
    bad = {r.path: r.non_finite for r in files.bad_cells(lines).collect()}
    for name, text in texts.items():
        path = f"{tmp_path}/{name}/r.csv"
        want = R.parse_text(text.encode().decode("utf-8-sig"))
        rows = sorted(got.get(path, []), key=lambda r: (r.t_ms if r.t_ms is not None else 0, r.at))
        assert (list(ids[path].channel_ids), list(ids[path].context_ids), list(ids[path].skipped)) == (want["channel_ids"], want["context_ids"], want["skipped"]), name
        if want["time_source"] == "column":
            assert [r.t_ms for r in rows] == want["t"], name
        else:
            assert all(r.t_ms is None for r in rows) and len(rows) == len(want["t"]), name
        assert [list(r.v) for r in rows] == [list(v) for v in zip(*(want["channels"][c] for c in want["channel_ids"]))], name
        assert bad[path] == want["non_finite"], name
    errors = {r.path: r.error for r in lines.where("error IS NOT NULL").collect()}
    assert set(errors) == {f"{tmp_path}/{name}/r.csv" for name in BAD} and all("ValueError" in e for e in errors.values())


def test_large_files_are_cut_and_small_ones_packed(spark, tmp_path):
    lay_out(tmp_path, {"a": "time,VOC\n" + "1,2\n" * 5000, "b": "time,VOC\n1,2\n", "c": "time,VOC\n1,2\n"})
    parts = files.Reader({"path": str(tmp_path), "splitbytes": "4096"}).partitions()
    assert [len(p.pieces) for p in parts] == [1] * 5 + [2]
    lines = files.read_lines(spark, str(tmp_path), splitBytes=4096)
    assert lines.rdd.getNumPartitions() == 6 and lines.where("substance = 'a'").count() == 5000


def test_conditions_are_pushed_to_the_listing(spark, tmp_path):
    lay_out(tmp_path, {name: "time,VOC\n1,2\n" for name in ("a", "b", "ba")})
    reader = files.Reader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("substance",), "b"), In(("path",), (f"{tmp_path}/b/r.csv", "x")), IsNotNull(("path",)), EqualTo(("at",), 3)]))
    assert [type(f) for f in left] == [IsNotNull, EqualTo] and [p[0] for p in reader.partitions()[0].pieces] == [f"{tmp_path}/b/r.csv"]
    reader = files.Reader({"path": str(tmp_path)})
    assert not list(reader.pushFilters([StringStartsWith(("substance",), "b")])) and len(reader.partitions()[0].pieces) == 2
    assert {r.substance for r in files.read_lines(spark, str(tmp_path)).where("substance in ('a', 'ba') AND at > 0").collect()} == {"a", "ba"}


def recordings(spark, n=6, broken=None):
    df = spark.range(0, n, 1, 3).select(
        F.concat(F.lit("s3://lab/"), F.when(F.col("id") % 2 == 0, "ethanol").otherwise("water"), F.lit("/r"), F.col("id"), F.lit(".csv")).alias("path"),
        F.lit("mox").alias("sensor_type"), F.array(F.lit("VOC"), F.lit("CO")).alias("channel_ids"), F.array(F.lit(0.0), F.lit(100.0)).alias("t"),
        F.create_map(F.lit("VOC"), F.array(F.col("id") + 0.5, F.lit(float("nan"))), F.lit("CO"), F.array(F.lit(1.0), F.lit(2.0))).alias("channels"),
        F.when(F.col("id") == F.lit(-1 if broken is None else broken), "no json").alias("manifest"), F.lit('[{"label": "on", "startMs": 0}]').alias("events"),
    )
    return df


def left_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_one_readable_file_for_each_recording(spark, tmp_path):
    files.write_files(recordings(spark), str(tmp_path))
    assert left_in(tmp_path) == ["_SUCCESS"] + [f"lab/ethanol/r{k}.zip" for k in (0, 2, 4)] + [f"lab/water/r{k}.zip" for k in (1, 3, 5)]
    again = {r.path: r for r in R.read_recordings(spark, str(tmp_path)).collect()}
    assert len(again) == 6 and all(r.ok and len(r.t) == 1 and r.events for r in again.values())  # the row with a NaN has an empty cell
    lines = files.read_lines(spark, str(tmp_path))
    assert {(r.substance, r.v[0]) for r in files.samples(lines).collect()} == {("ethanol" if k % 2 == 0 else "water", k + 0.5) for k in range(6)}
    assert lines.where("manifest IS NULL OR events IS NULL").count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="JSONDecodeError"):
        files.write_files(recordings(spark, broken=4), str(tmp_path))
    assert left_in(tmp_path) == []
    with pytest.raises(Exception, match="two recordings"):
        files.write_files(recordings(spark).unionByName(recordings(spark, 1)), str(tmp_path))
    assert left_in(tmp_path) == []


def test_appending_and_overwriting(spark, tmp_path):
    files.write_files(recordings(spark, 2), str(tmp_path))
    with pytest.raises(Exception, match="two recordings"):
        files.write_files(recordings(spark, 1), str(tmp_path))
    assert left_in(tmp_path) == ["_SUCCESS", "lab/ethanol/r0.zip", "lab/water/r1.zip"]
    files.write_files(recordings(spark, 1), str(tmp_path), overwrite=True)
    assert left_in(tmp_path) == ["_SUCCESS", "lab/ethanol/r0.zip"]
    assert files.Writer.target("../../etc/x.csv", ".zip") == "etc/x.zip"


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "time,VOC\n1,2\n")
        z.writestr("b.txt", "time,CO\n1,2\n2,3\n")
        z.writestr("c.txt", "")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("manifest.json", '{"sensor": {"channels": [{"id": "X"}]}}')
        z.writestr("data.csv", "time,VOC\n1,2\n")
    with zipfile.ZipFile(tmp_path / "half.zip", "w") as z:
        z.writestr("data.csv", "time,VOC\n1,2\n")
    lines = files.read_lines(spark, str(tmp_path))
    assert {r.path.rpartition("/")[2]: r.n for r in lines.where("error IS NULL").groupBy("path").agg(F.count("*").alias("n")).collect()} == {"two.zip!a.csv": 1, "two.zip!b.txt": 2}
    errors = {r.path.rpartition("/")[2]: r.error for r in lines.where("error IS NOT NULL").collect()}
    assert set(errors) == {"two.zip!c.txt", "bad.zip", "half.zip"} and "undeclared" in errors["bad.zip"]


def test_a_large_text_is_parsed_by_several_tasks(spark, tmp_path):
    """About 12 MB in one file, every range's rows against the whole file's numbers."""
    draw = random.Random(1)
    rows = [(k * 100, round(draw.random(), 3), draw.randrange(9)) for k in range(500_000)]
    (tmp_path / "big.csv").write_text("timestamp_ms,VOC,CO\n" + "".join(f"{t},{a},{b}\n" for t, a, b in rows))
    lines = files.read_lines(spark, str(tmp_path), splitBytes=1 << 20)
    assert lines.rdd.getNumPartitions() > 5
    got = files.samples(lines).agg(F.count("*").alias("n"), F.sum("t_ms").alias("t"), F.round(F.sum(F.get("v", F.lit(0))), 3).alias("a"), F.sum(F.get("v", F.lit(1))).alias("b")).first()
    assert (got.n, got.t, got.a, got.b) == (len(rows), sum(r[0] for r in rows), round(sum(r[1] for r in rows), 3), sum(r[2] for r in rows))


def test_declared_seconds_and_clocks_are_no_epoch_seconds(spark, tmp_path):
    """Three weeks of seconds, clock readings or dates of 1970 are milliseconds in the band of epoch seconds; only plain numbers are meant."""
    from vapora.sources import files
    from vapora.sources import recordings as R

    first = 2_000_000
    cell = {"Time (s)": lambda s: str(s), "elapsed": lambda s: f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}", "time": lambda s: f"1970-01-24T{s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z", "timestamp": str}
    want = {"Time (s)": 1e3, "elapsed": 1e3, "time": 1e3, "timestamp": 1e3 * 1e3}
    for name, k in want.items():
        text = f"{name},VOC\n" + "".join(f"{cell[name](first + s) if name != 'timestamp' else (first + s) * 1000},{s}\n" for s in range(40))
        got = R.parse_text(text)
        assert got["t"] == [(first + s) * k for s in range(40)]
        assert ("epoch seconds turned into milliseconds" in got["warnings"]) == (name == "timestamp")
        folder = tmp_path / name.replace(" ", "")
        folder.mkdir()
        (folder / "a.csv").write_text(text)
        assert sorted(r.t_ms for r in files.samples(files.read_lines(spark, str(folder))).collect()) == got["t"]


def test_variants_read_at_any_time(spark, tmp_path):
    """Texts of events whose seconds lie in the band of epoch seconds, and beyond a clock's three digits of hours."""
    from compare import same

    from vapora import queries

    ids = [3, 1_300_000, 3_599_999, 3_600_000, 5_000_000]
    rows = [(e + 10 * u, u, "view", 1.25 * k) for u in range(8) for k, e in enumerate(ids if u < 4 else ids[3:])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_millis(event_id + 1700000000000) AS ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    import duckdb

    duckdb.sql(f"COPY (SELECT * FROM '{tmp_path}/events/*.parquet') TO '{tmp_path}/events.parquet'")
    for t in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        duckdb.sql(f"COPY (SELECT 1 AS x) TO '{tmp_path}/{t}.parquet'")
    for name in ("csv_variants", "manifest_build"):
        same(queries.QUERIES[name](spark, str(tmp_path)), str(tmp_path), queries.ORACLE_SQL[name])


def test_recordings_leave_a_task_in_pieces(monkeypatch):
    """A task holds few parsed recordings at once, however many files come in one batch."""
    import pandas as pd

    from vapora.sources import recordings as R

    monkeypatch.setattr(R, "VALUES", 1000)
    text = ("timestamp_ms,VOC,CO\n" + "".join(f"{k * 100},{k},{k}\n" for k in range(100))).encode()
    frame = pd.DataFrame({"path": [f"u{k}" for k in range(40)], "substance": None, "content": [text] * 39 + [b"#"]})
    out = list(R._parse(iter([frame])))
    assert len(out) == 10 and [p for f in out for p in f["path"]] == list(frame["path"])
    assert sum(f["ok"].sum() for f in out) == 39


def test_files_come_to_a_task_by_bytes(spark):
    from vapora.sources import recordings as R

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, then in ((str(R.BYTES * 2), R.BYTES), ("1000", 1000)):
            spark.conf.set(name, given)
            R.reparse(spark.createDataFrame([("a", b"t,VOC")], "path string, content binary"))
            assert int(spark.conf.get(name).rstrip("b")) == then
    finally:
        spark.conf.set(name, before)
