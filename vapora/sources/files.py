"""The data source `recording_files`: recordings as files of their own, read in byte ranges and written one by one.

Reading gives a row per line of data, not per file, so one large CSV is parsed by many tasks. Small files are packed into
partitions, texts of more than splitBytes are cut into byte ranges at line ends (of splitBytes, or longer ones where that would
make more than RANGES, 64 MB at most), a ZIP's texts are read one after the other. A task looks at the
head of a file for its header, delimiter and kind of time column; what depends on all rows of a file (which columns hold a
number, whether times are epoch seconds, their order) is left to samples(), which aggregates it. Conditions on path and
substance are pushed down to the listing of files when spark.sql.python.filterPushdown.enabled is set.

Writing leaves one readable file per recording. Tasks write to a staging folder and send only their folder's name; write_files()
then compares names and moves files to their places in tasks, so the driver holds none of them. A save without it moves them in
the commit, by the driver. An abort deletes what was staged, so a failed job or a repeated task leaves nothing behind.

Files are reached by pyarrow's file systems, so a path may be local or in any store that pyarrow knows.

Cases: a file without a row of data, or one that can't be read, gives one row with its error. Two recordings of one path stop the
write. An empty folder gives no rows.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from vapora.sources import cells, scratch
from vapora.sources import recordings as R

FORMAT = "recording_files"
#: A row per line: at orders the lines of a file, numbers has a value per column of the header, NULL where a cell holds none; plain tells a time that is a number in no declared seconds.
LINES = "path string, substance string, at long, header array<string>, time_column int, time_source string, delimiter string, whole boolean, t_ms double, numbers array<double>, manifest string, events string, error string, plain boolean"
#: The file of a staging folder that names the folders of the tasks whose files count.
FOLDERS = "_folders.json"
#: What a writer takes: recordings, or lines of text in order.
_TEXT = {"path", "line"}
#: Bytes of a partition, bytes of a file's head that are read at once, rows that tell whether a column holds times.
SPLIT, HEAD, TIMED = 64 << 20, 1 << 16, 25
#: Ranges of a file at most, as long as none exceeds SPLIT: a task's start takes as long as reading some 100 kB.
RANGES = 32
_ARROW = pa.schema([("path", pa.string()), ("substance", pa.string()), ("at", pa.int64()), ("header", pa.list_(pa.string())), ("time_column", pa.int32()), ("time_source", pa.string()), ("delimiter", pa.string()), ("whole", pa.bool_()), ("t_ms", pa.float64()), ("numbers", pa.list_(pa.float64())), ("manifest", pa.string()), ("events", pa.string()), ("error", pa.string()), ("plain", pa.bool_())])


@dataclass
class Slice(InputPartition):
    """Pieces of files: (path, first byte, end, whether it is a ZIP)."""

    pieces: list[tuple[str, int, int, bool]]


@dataclass
class Layout:
    """What the head of a text tells: names, delimiter, the time column and its unit, and the first byte behind the header."""

    header: list[str]
    by: str
    time: tuple[int, bool] | None
    timed: bool
    begin: int


def _kept(raw: bytes) -> list[str]:
    """Lines of data in a piece of text that ends with a line: no blank lines, no comments."""
    return [x for x in map(str.strip, raw.decode("utf-8", "replace").splitlines()) if x and x[0] != "#"]


def layout(head: Iterator[bytes]) -> Layout:
    """The layout of a text from its first pieces, of which as many are taken as are needed."""
    raw, header, begin = b"", None, 0
    for piece in head:
        raw += piece
        body = raw[begin:].rpartition(b"\n")[0] if piece else raw[begin:]
        if header is None:
            at = 0
            for line in body.split(b"\n"):
                at += len(line) + 1
                if kept := _kept(line.removeprefix(b"\xef\xbb\xbf")):
                    header, begin = kept[0], at
                    break
            body = body[begin:]
        if header is None:
            continue
        rows = _kept(body)
        if rows:
            by = cells.delimiter(rows[0])
            names = [h.strip() for h in cells.split_row(header, by)]
            first = [r for r in (cells.split_row(x, by) for x in rows) if len(r) == len(names)][:TIMED]
            if len(first) == TIMED or not piece:
                time = cells.time_column(names)
                return Layout(names, by, time, time is not None and any(cells.time_ms(r[time[0]], time[1]) is not None for r in first), begin)
    raise ValueError("the file has no data rows" if header else "the file is empty")


def _pieces(f: io.IOBase) -> Iterator[bytes]:
    while piece := f.read(HEAD):
        yield piece
    yield b""


def _range(f: io.IOBase, begin: int, end: int, of: Layout) -> bytes:
    """The lines whose first byte is in the range, without the header."""
    begin = max(begin, of.begin)
    if begin >= end:
        return b""
    f.seek(begin - 1)
    raw = f.read(end - begin + 1)
    if begin > of.begin:  # the line that reaches into the range belongs to the one before
        raw = raw.partition(b"\n")[2]
    else:
        raw = raw[1:]
    if raw and not raw.endswith(b"\n"):
        while piece := f.read(HEAD):
            line, newline, _ = piece.partition(b"\n")
            raw += line + newline
            if newline:
                break
    return raw


def _batches(path: str, substance: str, of: Layout, lines: list[str], begin: int, more: dict) -> Iterator[pa.RecordBatch]:
    at, seconds = of.time or (None, False)
    source = "column" if of.timed else "synthetic"
    for lo in range(0, len(lines), 4096):
        rows = [cells.split_row(x, of.by) for x in lines[lo : lo + 4096]]
        n = len(rows)
        whole = [len(r) == len(of.header) for r in rows]
        t = [cells.time_ms(r[at], seconds) if w and of.timed else None for r, w in zip(rows, whole)]
        plain = [w and of.timed and not seconds and cells.number(r[at]) is not None for r, w in zip(rows, whole)]
        # an incomplete row still tells which of its columns hold numbers
        numbers = [[cells.number(x) for x in r[: len(of.header)]] + [None] * (len(of.header) - len(r)) for r in rows]
        columns = [[path] * n, [substance] * n, list(range(begin + lo, begin + lo + n)), [of.header] * n, [at] * n, [source] * n, [of.by] * n, whole, t, numbers, [more.get("manifest")] * n, [more.get("events")] * n, [None] * n, plain]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _failed(path: str, substance: str, error: Exception) -> pa.RecordBatch:
    row = dict.fromkeys(_ARROW.names) | {"path": path, "substance": substance, "error": f"{type(error).__name__}: {error}"}
    return pa.RecordBatch.from_pylist([row], _ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT))
        self.endings = tuple(x.strip().lower() for x in options.get("endings", ".csv,.txt,.zip").split(","))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) in (("path",), ("substance",)) else None
            if column and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif column and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column and isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", (f.value,)))
            else:
                yield f

    def _asked(self, path: str) -> bool:
        has = {"path": path, "substance": posixpath.basename(posixpath.dirname(path))}
        return all(has[c] in values if how == "in" else has[c].startswith(values) for c, how, values in self.wanted)

    def partitions(self) -> list[Slice]:
        store, base = pafs.FileSystem.from_uri(self.path)
        out, packed, size = [], [], 0
        for info in sorted(store.get_file_info(pafs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            hidden = any(x.startswith(("_", ".")) for x in posixpath.relpath(info.path, base).split("/"))
            if info.type != pafs.FileType.File or hidden or not info.path.lower().endswith(self.endings) or not self._asked(info.path):
                continue
            is_zip = info.path.lower().endswith(".zip")
            if info.size > self.split and not is_zip:
                step = max(self.split, min(SPLIT, -(-info.size // RANGES)))
                out += [Slice([(info.path, lo, min(info.size, lo + step), False)]) for lo in range(0, info.size, step)]
                continue
            if packed and size + info.size > self.split:
                out.append(Slice(packed))
                packed, size = [], 0
            packed.append((info.path, 0, info.size, is_zip))
            size += info.size
        return [*out, Slice(packed)] if packed or not out else out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        for path, begin, end, is_zip in partition.pieces:
            substance = posixpath.basename(posixpath.dirname(path))
            try:
                with store.open_input_file(path) as f:
                    if is_zip:
                        yield from self._members(path, substance, f)
                        continue
                    of = layout(_pieces(f))
                    raw = _range(f, begin, end, of)
                yield from _batches(path, substance, of, _kept(raw), max(begin, of.begin), {})
            except Exception as e:  # noqa: BLE001  a file's error is its row's
                if begin == 0:
                    yield _failed(path, substance, e)

    def _members(self, path: str, substance: str, f: io.IOBase) -> Iterator[pa.RecordBatch]:
        """A bundle is one recording; any other ZIP has a recording in each of its texts."""
        with zipfile.ZipFile(f) as z:
            names = sorted(z.namelist())
            bundle = "manifest.json" in names or "data.csv" in names
            if bundle and not {"manifest.json", "data.csv"} <= set(names):
                raise R.BundleError("the bundle lacks manifest.json or data.csv")
            more = {}
            if bundle:
                more = {"manifest": json.dumps(json.loads(z.read("manifest.json"))), "events": json.dumps(json.loads(z.read("events.json"))) if "events.json" in names else None}
            for name in ["data.csv"] if bundle else [n for n in names if n.lower().endswith((".csv", ".txt"))]:
                own = path if bundle else f"{path}!{name}"
                try:
                    with z.open(name) as m:
                        of = layout(_pieces(m))
                    with z.open(name) as m:
                        m.seek(of.begin)
                        raw = m.read()
                    if bundle:
                        _agree(json.loads(more["manifest"]), of.header, of.time, raw, of.by)
                    yield from _batches(own, substance, of, _kept(raw), of.begin, more)
                except Exception as e:  # noqa: BLE001
                    yield _failed(own, substance, e)


def _agree(manifest: dict, header: list[str], time: tuple[int, bool] | None, raw: bytes, by: str) -> None:
    """A bundle's declared channels and its columns of numbers, context apart, are the same sets."""
    rows = [cells.split_row(x, by) for x in _kept(raw)]
    has = set(R._roles(header, rows, time[0] if time else None)["channel"])
    declared = {c["id"] for c in manifest.get("sensor", {}).get("channels", [])}
    if declared != has:
        raise R.BundleError(f"undeclared columns {sorted(has - declared)}, channels without data {sorted(declared - has)}")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class Writer(DataSourceWriter):
    """Rows of recordings leave a bundle each."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.kept = "staging" in options  # who gives the folder moves its files
        self.staging = options.get("staging", f"_staging-{uuid.uuid4().hex}")
        if set(schema.names) != _TEXT and not {"path", "channel_ids", "t", "channels"} <= set(schema.names):
            raise ValueError("recording_files takes recordings, or rows of path and line")

    @staticmethod
    def _contents(iterator: Iterator) -> Iterator[tuple[str, bytes, bool]]:
        """Names of files, bytes of theirs, and whether these may go on with the file before."""
        for row in iterator:
            yield Writer.target(row["path"], ".zip"), _bundle(row), False

    @staticmethod
    def target(path: str, ending: str | None) -> str:
        """A recording's place below the folder: without scheme, root and dots."""
        plain = posixpath.normpath("/" + path.partition("://")[2] if "://" in path else "/" + path).lstrip("/")
        return posixpath.splitext(plain)[0] + ending if ending else plain

    def write(self, iterator: Iterator) -> Staged:
        store, base = pafs.FileSystem.from_uri(self.path)
        folder, done = f"{self.staging}/{uuid.uuid4().hex}", set()
        try:
            open_path, out, made = None, None, None
            for name, raw, more in self._contents(iterator):
                if more and name == open_path:
                    out.write(raw)
                    continue
                if name in done:
                    raise ValueError(f"two recordings would be {name}")
                done.add(name)
                if out:
                    out.close()
                at = f"{base}/{folder}/{name}"
                if made != (made := posixpath.dirname(at)):
                    store.create_dir(made, recursive=True)
                out, open_path = store.open_output_stream(at), name
                out.write(raw)
            if out:
                out.close()
        except BaseException:
            _delete(store, f"{base}/{folder}")
            raise
        return Staged(folder, len(done))

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        if self.kept:
            store.create_dir(f"{base}/{self.staging}", recursive=True)
            with store.open_output_stream(f"{base}/{self.staging}/{FOLDERS}") as out:
                out.write(json.dumps([m.folder for m in messages if m and m.files]).encode())
            return
        moves: dict[str, str] = {}
        for m in messages:
            if m and m.files:
                root = f"{base}/{m.folder}"
                for info in store.get_file_info(pafs.FileSelector(root, recursive=True)):
                    if info.type == pafs.FileType.File:
                        to = f"{base}/{posixpath.relpath(info.path, root)}"
                        if to in moves or not self.overwrite and store.get_file_info(to).type != pafs.FileType.NotFound:
                            self.abort(messages)
                            raise ValueError(f"two recordings would be {to}")
                        moves[to] = info.path
        if self.overwrite:
            _clear(store, base, self.staging)
        for folder in {posixpath.dirname(to) for to in moves}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: store.move(m[1], m[0]), moves.items()))
        _finish(store, base, self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        _delete(store, f"{base}/{self.staging}")


class TextWriter(Writer, DataSourceArrowWriter):
    """Rows of path and line leave texts, whose lines come in order; the lines of one path in a batch are written at once."""

    @staticmethod
    def _contents(iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, bool]]:
        for batch in iterator:
            rows = zip(batch.column("path").to_pylist(), batch.column("line").to_pylist(), strict=True)
            for path, lines in groupby(rows, itemgetter(0)):
                yield Writer.target(path, None), "".join(f"{x}\n" for _, x in lines).encode(), True


def _delete(store: pafs.FileSystem, path: str) -> None:
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


def _clear(store: pafs.FileSystem, base: str, staging: str) -> None:
    """Deletes what a folder holds beside what is staged."""
    for info in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if posixpath.basename(info.path) != staging:
            store.delete_dir(info.path) if info.type == pafs.FileType.Directory else store.delete_file(info.path)


def _finish(store: pafs.FileSystem, base: str, staging: str) -> None:
    _delete(store, f"{base}/{staging}")
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/_SUCCESS"):
        pass


def _staged(store: pafs.FileSystem, base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
    """The staged files of tasks' folders and their places, some thousand at once."""
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            root = f"{base}/{folder}"
            found = [i.path for i in store.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File]
            for lo in range(0, len(found), 4096):
                yield [(at, f"{base}/{posixpath.relpath(at, root)}") for at in found[lo : lo + 4096]]


def _places(path: str, free: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The places of staged files, and whether a file lies there already; with free none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(path)
        for some in _staged(store, base, batches):
            to = [place for _, place in some]
            taken = [False] * len(to) if free else [i.type != pafs.FileType.NotFound for i in store.get_file_info(to)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.string()), pa.array(taken, pa.bool_())], ["place", "taken"])

    return run


def _moves(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Moves staged files to their places; a repeated task finds those that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(path)
        made = None
        for some in _staged(store, base, batches):
            for at, to in some:
                if made != (made := posixpath.dirname(to)):
                    store.create_dir(made, recursive=True)
                try:
                    store.move(at, to)
                except OSError:  # another attempt of this task was faster
                    if store.get_file_info(to).type == pafs.FileType.NotFound:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64())], ["moved"])

    return run


def _settle(spark: SparkSession, path: str, staging: str, overwrite: bool) -> None:
    """Gives staged files their places by tasks, if no two have the same and, unless they overwrite, none is taken."""
    store, base = pafs.FileSystem.from_uri(path)
    try:
        with store.open_input_file(f"{base}/{staging}/{FOLDERS}") as f:
            folders = json.loads(f.read())
        if folders:
            tasks = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders))
            free = overwrite or len(store.get_file_info(pafs.FileSelector(base))) == 1
            places = tasks.mapInArrow(_places(path, free), "place string, taken boolean").groupBy("place").agg((F.max("taken") | (F.count("*") > 1)).alias("twice"))
            twice = places.where("twice").agg(F.min("place")).first()[0]
            if twice is not None:
                raise ValueError(f"two recordings would be {twice}")
        if overwrite:
            _clear(store, base, staging)
        if folders:
            tasks.mapInArrow(_moves(path), "moved long").agg(F.sum("moved")).collect()
    except BaseException:
        _delete(store, f"{base}/{staging}")
        raise
    _finish(store, base, staging)


def _bundle(row) -> bytes:
    ids, has = list(row["channel_ids"]), row.asDict()
    manifest = json.loads(has["manifest"]) if has.get("manifest") else {"formatVersion": "1.0", "sensor": {"sensorType": has.get("sensor_type") or "unknown", "channels": [{"id": c, "unit": "adc"} for c in ids]}}
    return R.to_bundle(manifest, list(row["t"]), {c: list(row["channels"][c]) for c in ids}, json.loads(has["events"]) if has.get("events") else None)


class RecordingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return (TextWriter if set(schema.names) == _TEXT else Writer)(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The lines of the recordings under a folder (LINES). Options: splitBytes, endings."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Recordings as bundles, one file each; or rows of path and line, in order and one path's together, as texts."""
    register(df.sparkSession)
    staging = f"_staging-{uuid.uuid4().hex}"
    df.write.format(FORMAT).option("staging", staging).mode("append").save(path)
    _settle(df.sparkSession, path, staging, overwrite)


def columns(lines: DataFrame) -> DataFrame:
    """path, k, name, place and role of every column of every file but its time: context by name, channel if any row has a number in it, else skipped.

    Of names that repeat the first is meant: place is that one's.
    """
    of = lines.where("error IS NULL")
    seen = of.select("path", F.posexplode("numbers").alias("place", "x")).groupBy("path", "place").agg(F.max(F.col("x").isNotNull()).alias("holds"))
    names = of.groupBy("path").agg(F.first("header").alias("header"), F.first("time_column").alias("time_column"))
    named = names.select("path", "time_column", "header", F.posexplode("header").alias("k", "name")).where("time_column IS NULL OR k <> time_column")
    named = named.select("path", "k", "name", (F.array_position("header", F.col("name")) - 1).cast("int").alias("place"))
    role = F.when(cells.context_column(F.col("name")), "context").when(F.col("holds"), "channel").otherwise("skipped")
    return named.join(seen, ["path", "place"]).select("path", "k", "name", "place", role.alias("role"))


def channel_table(lines: DataFrame) -> DataFrame:
    """path with its channels: ids and their places in the header, and the names of context and skipped columns."""
    pick = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("k", "name", "place"))))
    g = columns(lines).groupBy("path").agg(*(pick(r).alias(r) for r in ("channel", "context", "skipped")))
    return g.select("path", F.col("channel.name").alias("channel_ids"), F.col("channel.place").alias("places"), F.col("context.name").alias("context_ids"), F.col("skipped.name").alias("skipped"))


def samples(lines: DataFrame) -> DataFrame:
    """Rows with a time and a number in every channel: path, substance, at, t_ms, channel_ids and v, the channels' values.

    Without a time column t_ms is NULL: the row's place in its file then gives the time, as segments.place() finds it.
    """
    kept = lines.where("error IS NULL AND whole").join(channel_table(lines), "path")
    v = F.transform("places", lambda k: F.get("numbers", k))
    kept = kept.select("path", "substance", "at", "time_source", "t_ms", "plain", "channel_ids", v.alias("v"))
    kept = kept.where((F.col("t_ms").isNotNull() | (F.col("time_source") == "synthetic")) & ~F.exists("v", lambda x: x.isNull()))
    # epoch seconds: the upper median of the plain numbers lies in the band if its rank lies behind those below and not behind those in it
    lo, hi = cells.EPOCH_S
    n, t = F.count_if("plain"), F.when(F.col("plain"), F.col("t_ms"))
    band = kept.groupBy("path").agg(((F.count_if(t < lo) <= F.floor(n / 2)) & (F.count_if(t <= hi) > F.floor(n / 2))).alias("epoch"))
    kept = kept.join(band, "path")
    return kept.withColumn("t_ms", F.when(F.col("epoch") & F.col("plain"), F.col("t_ms") * 1000.0).otherwise(F.col("t_ms"))).drop("plain")


def bad_cells(lines: DataFrame) -> DataFrame:
    """path and non_finite: rows without a time, and cells without a number in the channels of the others."""
    whole = lines.where("error IS NULL AND whole").join(channel_table(lines), "path")
    untimed = F.col("t_ms").isNull() & (F.col("time_source") == "column")
    holes = F.size(F.filter(F.transform("places", lambda k: F.get("numbers", k)), lambda x: x.isNull()))
    return whole.groupBy("path").agg(F.sum(F.when(untimed, 1).otherwise(holes)).alias("non_finite"))


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of one large text for each kind of event: path, line, in the order of event_id behind the header."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    line = F.concat_ws(",", F.col("ms").cast("string"), F.format_string("%.2f", "value"), F.when(F.col("event_id") % 50 == 0, "n/a").otherwise((F.col("event_id") % 97).cast("string")), F.lit("note"))
    path = F.concat("event_type", F.lit("/all.csv"))
    rows = e.select(path.alias("path"), "event_id", line.alias("line"))
    head = e.select(path.alias("path")).distinct().select("path", F.lit(-1).cast("long").alias("event_id"), F.lit("# made\ntimestamp_ms,VOC,CO,remark").alias("line"))
    return rows.unionByName(head).repartition("path").sortWithinPartitions("path", "event_id").select("path", "line")


def _written(spark: SparkSession, sf_dir: str) -> str:
    at = scratch.folder(spark, "files")
    write_files(_event_lines(spark, sf_dir), at)
    return at


def _q_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large texts written one per kind of event, parsed in byte ranges of 16 kB."""
    lines = read_lines(spark, _written(spark, sf_dir), splitBytes=1 << 14).withColumn("task", F.spark_partition_id())
    lines = scratch.stored(lines, "lines")  # parsed once, read by several aggregates
    good = samples(lines).groupBy("path", "substance", "channel_ids").agg(F.count("*").alias("n_samples"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.sum(F.get("v", F.lit(0))).alias("voc"), F.sum(F.get("v", F.lit(1))).alias("co"))
    out = good.join(bad_cells(lines), "path")
    parts = lines.groupBy("path").agg((F.count_distinct("task") > 1).alias("shared"))
    rounded = lambda c: F.floor(F.col(c) * 1000 + 0.50037) / 1000
    return out.join(parts, "path").select("substance", F.array_join("channel_ids", ",").alias("channels"), "n_samples", "non_finite", "first_ms", "last_ms", rounded("voc").alias("voc_sum"), rounded("co").alias("co_sum"), "shared")


def _q_bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle per user written as a file, listed, and read again under a pushed condition."""
    at = scratch.folder(spark, "bundles")
    write_files(R.reparse(R._texts(spark, sf_dir)).where("ok"), at)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(at).groupBy().agg(F.count("*").alias("n_files"))
    base = F.regexp_extract("path", "([^/]+)\\.zip$", 1)
    lines = scratch.stored(read_lines(spark, at).where("substance = 'user'"), "lines")
    got = samples(lines).groupBy(base.cast("long").alias("user_id")).agg(F.count("*").alias("n_samples"), F.sum(F.get("v", F.lit(0))).alias("voc"))
    return got.join(F.broadcast(listed)).select("user_id", "n_samples", (F.floor(F.col("voc") * 1000 + 0.50037) / 1000).alias("voc_sum"), "n_files")


QUERIES = {"csv_split_scan": _q_split_scan, "bundle_files": _q_bundle_files}
_GOOD = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms, round(value, 2) AS v, event_id % 50 <> 0 AS good FROM events)"
ORACLE_SQL = {
    "csv_split_scan": f"""WITH {_GOOD} SELECT event_type AS substance, 'VOC,CO' AS channels, count(*) FILTER (good) AS n_samples, count(*) FILTER (NOT good) AS non_finite, (min(ms) FILTER (good))::DOUBLE AS first_ms, (max(ms) FILTER (good))::DOUBLE AS last_ms,
  floor(sum(v) FILTER (good) * 1000 + 0.50037) / 1000 AS voc_sum, floor((sum(event_id % 97) FILTER (good))::DOUBLE * 1000 + 0.50037) / 1000 AS co_sum, sum(23 + length(printf('%.2f', value)) + length((event_id % 97)::VARCHAR)) > 16384 AS shared FROM e GROUP BY event_type""",
    "bundle_files": f"WITH {_GOOD} SELECT user_id, count(*) AS n_samples, floor(sum(v) * 1000 + 0.50037) / 1000 AS voc_sum, (SELECT count(DISTINCT user_id) FROM e WHERE good) AS n_files FROM e WHERE good GROUP BY user_id",
}
