"""Exact deduplication over a log-structured merge index.

Memtables gather the digests of a task's documents and flush them as sorted runs, one for each digest range, each digest once
with its smallest id and its count; with a run goes a filter of its digests. Compaction merges the runs of a range. By their
filters it first sets aside the digests that no second run may hold; of those that remain it keeps the smallest identifier,
and only digests found more than once stay in the index. Documents that pass a filter of the index look their digest up,
and every hit is compared byte by byte with the document that stays.

Cases: a null text counts as empty, and so equals other empty texts; repeated rows of one doc_id count as members, and
all of them share that id's verdict; a null doc_id is never the smallest unless all ids of the group are null, and
then every such row is kept; an empty table gives an empty result; columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import common

#: Digests that one memtable holds before it flushes a run, and that one range of the index holds, about.
MEMTABLE, RANGE = 1 << 17, 1 << 20
#: Members of a hot group that are compared in one salt. A digest is hot from that many rows on, and from one row in
#: HOT_SHARE, so that at most HOT_SHARE hot digests (40 bytes each) are broadcast.
SALT_ROWS, HOT_SHARE = 512, 1_000_000

_RUN = "bucket int, digests binary, ids binary, counts binary, filter binary"
_HITS = "digest binary, keep_id long, n long"
_NO_ID = np.iinfo(np.int64).max
#: Bits of a run's filter for each of its digests.
_SPARE = 16


def _combine(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted digests, each once, with the smallest id and the summed counts. The sort merges runs that are sorted already."""
    order = np.argsort(digests, kind="stable")
    digests, ids, counts = digests[order], ids[order], counts[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]]) if len(digests) else np.zeros(0, int)
    return digests[first], np.minimum.reduceat(ids, first) if len(first) else ids, np.add.reduceat(counts, first) if len(first) else counts


def _places(raw: np.ndarray, bits: int) -> np.ndarray:
    """Places of digests (rows of 32 bytes) in a filter of 2 ** bits."""
    return raw[:, 24:32].copy().view("<u8").ravel() & np.uint64((1 << bits) - 1)


def _flush(digests: list[bytes], ids: np.ndarray, bits: int, filter_bits: int) -> Iterator[pa.RecordBatch]:
    keys, least, counts = _combine(np.array(digests, dtype="S32"), ids, np.ones(len(ids), np.int64))
    raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, 32)
    bucket = (raw[:, :4].copy().view(">u4").ravel() >> np.uint32(32 - bits)).astype(np.int32) if bits else np.zeros(len(raw), np.int32)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        held = np.unique(_places(raw[a:b], filter_bits)).astype("<u4")
        rows.append((int(bucket[a]), raw[a:b].tobytes(), least[a:b].tobytes(), counts[a:b].tobytes(), held.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "digests", "ids", "counts", "filter"])


def _memtables(bits: int, filter_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            digests += batch.column(1).to_pylist()
            ids.append(batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False))
            if len(digests) >= MEMTABLE:
                yield from _flush(digests, np.concatenate(ids), bits, filter_bits)
                digests, ids = [], []
        if digests:
            yield from _flush(digests, np.concatenate(ids), bits, filter_bits)

    return run


def _compact(filter_bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs = list(zip(*(table.column(c).to_pylist() for c in ("digests", "ids", "counts", "filter")), strict=True))
        holders = np.zeros(1 << filter_bits, np.uint16)
        for *_, held in runs:
            at = np.frombuffer(held, "<u4")
            holders[at] = np.minimum(holders[at], 2) + 1
        parts = []
        for digests, ids, counts, _ in runs:
            raw, ids, counts = np.frombuffer(digests, np.uint8).reshape(-1, 32), np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
            may = (counts > 1) | (holders[_places(raw, filter_bits)] > 1)
            parts.append((np.frombuffer(raw[may].tobytes(), "S32"), ids[may], counts[may]))
        digests, ids, counts = _combine(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        many = counts > 1
        raw, least = digests[many].tobytes(), ids[many]
        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), int(many.sum()), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return pa.table({"digest": keys, "keep_id": pa.array(least, mask=least == _NO_ID), "n": pa.array(counts[many])})

    return run


def build_index(rows: DataFrame, total: int, tasks: int) -> DataFrame:
    """Compacted index of rows (doc_id, digest): digest, keep_id and n of the digests found more than once."""
    bits = min(24, max(total // RANGE, tasks - 1).bit_length())
    filter_bits = min(24, max(8, (_SPARE * min(total >> bits, 4 * RANGE)).bit_length()))
    runs = rows.select("doc_id", "digest").mapInArrow(_memtables(bits, filter_bits), _RUN)
    return common.materialize(runs.groupBy("bucket").applyInArrow(_compact(filter_bits), _HITS), "digest-index")


def _hot(index: DataFrame, total: int) -> DataFrame:
    """Digests that hold at least SALT_ROWS rows and one row in HOT_SHARE: digest, salts."""
    return index.where(F.col("n") > max(SALT_ROWS, total // HOT_SHARE)).select("digest", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))


def _verdicts(docs: DataFrame, carry: bool, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """row (the document's columns, or null), doc_id, keep_id, n and sha of every row of docs."""
    common.small_batches(docs.sparkSession)
    sha = lambda c: F.unhex(F.sha2(F.encode(c, "UTF-8"), 256))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if carry else F.lit(None).cast("int").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{common.SPACE}+", " ").alias("norm"))
    rows = rows.withColumn("sha", sha(F.col("norm")))
    rows = rows.withColumn("digest", digest(F.col("norm")) if digest else F.col("sha"))
    total = docs.count()
    index = build_index(rows, total, common.partitions(docs.sparkSession))
    marked = common.Filter(index.select(F.xxhash64("digest").alias("number")), "number").mark(rows, F.xxhash64("digest"), "seen")
    hot = F.broadcast(_hot(index, total))

    # Members of hot digests are dealt over several salts, and what they meet is repeated for each salt.
    hits = marked.where("seen").join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    entries = common.spread(index.join(hot, "digest", "left"), F.coalesce("salts", F.lit(1))).drop("salts")
    found = hits.join(entries, ["digest", "salt"], "left")
    stays = found.where(F.col("n").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = common.spread(stays.groupBy("digest").agg(F.min("norm").alias("keep_norm"), F.first("salts").alias("salts")), F.coalesce("salts", F.lit(1))).drop("salts")
    pairs = found.join(stays, ["digest", "salt"], "left")
    checked = common.materialize(
        pairs.select("row", "doc_id", "sha", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"), (F.col("n").isNull() | (F.col("norm") == F.col("keep_norm"))).alias("same"), F.when(F.col("norm") != F.col("keep_norm"), F.col("norm")).alias("other")),
        "verified-hits",
    )
    if not checked.where("not same").isEmpty():
        checked = _regrouped(checked)
    once = marked.where("not seen").select("row", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    return once.unionByName(checked.select("row", "doc_id", "sha", "keep_id", "n"))


def exact_dedup(docs: DataFrame, carry: tuple[str, ...] = (), digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the carried columns, a row for every row of docs.

    digest maps the normalised text to 32 bytes; it is SHA-256 unless given. Two texts of one digest are told apart by
    their bytes.
    """
    found = _verdicts(docs, bool(carry), digest)
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *(F.col("row")[c].alias(c) for c in carry if c != "doc_id"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    return _verdicts(docs, True).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("row.*")


def _regrouped(checked: DataFrame) -> DataFrame:
    """Where bytes refuse a digest's group: equal texts grouped by their bytes."""
    groups = checked.groupBy("digest", "other").agg(F.min("doc_id").alias("g_keep"), F.count("*").alias("g_n"))
    split = checked.join(groups, (checked.digest == groups.digest) & checked.other.eqNullSafe(groups.other)).drop(groups.digest).drop(groups.other)
    return split.withColumn("keep_id", F.coalesce("g_keep", "doc_id")).withColumn("n", F.when(F.col("n") > 1, F.col("g_n")).otherwise(F.lit(1).cast("long")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
