"""Folders of many files: neither their listing nor their moves nor a row for each of them is the driver's."""

import os

from vapora.operators import study
from vapora.sources import files
from vapora.sources import recordings as R


def left_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The same files as Spark's own listing, by path and substance, of which the driver's plan names none."""
    for at in ("a é/f 1.csv", "a é/x=1/g.TXT", "a é/x=1/_g.csv", "_hidden/h.csv", ".dot/h.csv", "_k=1.csv", ".z.csv", "top.csv", "br{a}.csv", "m.Csv", "deep/er/still/n.csv"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("time,VOC\n1,2\n2,3\n")
    (tmp_path / "deep" / "bad.csv").write_text("# nothing\n")
    (tmp_path / "empty").mkdir()
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,txt,CSV,TXT,zip,ZIP}").load(str(tmp_path))
    got = R.read_recordings(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == sorted(r.path for r in own.select("path").collect()) and got.count() == 7
    assert {(r.path.rsplit("/", 1)[1], r.substance, r.ok) for r in got.collect()} >= {("f 1.csv", "a é", True), ("g.TXT", "x=1", True), ("n.csv", "still", True), ("bad.csv", "deep", False)}
    assert all("/listing-" in f for f in got.inputFiles())
    assert R.read_recordings(spark, str(tmp_path), "*.TXT", label_from_dir=False).select("substance").collect() == [(None,)]
    assert R.read_recordings(spark, str(tmp_path / "empty")).count() == 0
    assert R.read_recordings(spark, str(tmp_path / "top.csv")).first().ok and R.read_recordings(spark, str(tmp_path / "t*.csv")).count() == 1


def test_names_are_listed_and_files_opened_by_pieces(tmp_path, monkeypatch):
    """A folder's names leave the listing by NAMES; contents come by BYTES, a file that is gone with its error."""
    import pandas as pd
    import pyarrow as pa

    for k in range(50):
        (tmp_path / f"u{k}.csv").write_text("time,VOC\n" + "".join(f"{j},{j}\n" for j in range(20)))
    monkeypatch.setattr(R, "NAMES", 20)
    found = list(R._listing(f"file:{tmp_path}")(iter([pa.RecordBatch.from_pydict({"path": [""]})])))
    assert [b.num_rows for b in found] == [20, 20, 10] and {x for b in found for x in b.column("path").to_pylist()} == {f"/u{k}.csv" for k in range(50)}
    given = []
    monkeypatch.setattr(R, "BYTES", 1000)
    monkeypatch.setattr(R, "_parse", lambda frames: (given.append(len(f)) or f for f in frames))
    at = ["/gone.csv"] + [f"/u{k}.csv" for k in range(50)]
    out = pd.concat(R._opened(f"file:{tmp_path}")(iter([pd.DataFrame({"at": at, "path": at, "substance": None})])))
    assert list(out["at"]) == at and max(given) < 20 and isinstance(out["content"].iloc[0], FileNotFoundError) and b"time,VOC" in out["content"].iloc[-1]


def test_staged_files_are_left_to_tasks(spark, tmp_path):
    """The commit of write_files moves nothing: it names the tasks' folders; of a repeated task's folder nothing counts."""
    for at in ("one/k/a.csv", "again/k/a.csv", "two/k/b.csv"):
        (tmp_path / "_s" / at).parent.mkdir(parents=True)
        (tmp_path / "_s" / at).write_text(at)
    files.Writer({"path": str(tmp_path), "staging": "_s"}, spark.createDataFrame([], "path string, line string").schema, False).commit([files.Staged("_s/one", 1), files.Staged("_s/two", 1), None])
    assert {"_s/one/k/a.csv", "_s/two/k/b.csv"} < set(left_in(tmp_path))
    files._settle(spark, str(tmp_path), "_s", False)
    assert left_in(tmp_path) == ["_SUCCESS", "k/a.csv", "k/b.csv"] and (tmp_path / "k/a.csv").read_text() == "one/k/a.csv"


def test_recordings_of_a_collection_are_not_broadcast(spark, sf):
    plan = study.QUERIES["collection_report"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
