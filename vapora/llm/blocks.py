"""Packed exchange of keys between blocks of documents and a table over all documents.

A block is a bounded batch of one task's documents. It names its distinct keys once, dealt by their digests over buckets,
and keeps for each document the places of its keys in the block's list. Buckets see each key once a block, so a key that
every document holds is no hot spot. Replies go back to the block, in the order of its keys. Everything travels as packed
arrays, compressed where it repeats: a few rows per block and bucket, not one per key and document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext

from vapora.llm.common import SLICE, slices

#: Symbols (bytes) of text that one block holds.
BLOCK_BYTES = 10 << 20


def buckets_for(rows: int) -> int:
    """Buckets of keys, a power of two in proportion to the documents."""
    return 1 << max(5, (rows >> 12).bit_length())


def digests(keys: list[bytes]) -> np.ndarray:
    """64-bit digests of keys."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k) for k in keys), np.uint64, len(keys))


def bucket_of(digest: np.ndarray, buckets: int) -> np.ndarray:
    """The first bits of a digest; a power of two of buckets."""
    return (digest >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Integers as bytes, in the fewest planes of bytes that hold them, compressed."""
    a = np.ascontiguousarray(a)
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    width = 1 << (width - 1).bit_length()
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def block_number(n: int) -> int:
    """The n-th block of this task; a retry of the task gives its blocks the same numbers."""
    return (TaskContext.get().partitionId() << 24) + n


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def stream(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def open_stream(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, .. of each run, run after run."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 0) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of a task's documents in blocks of about BLOCK_BYTES; a null text is empty."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in slices(batches, "text", SLICE):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            held += len(texts[-1])
            if held > (size or BLOCK_BYTES):
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
