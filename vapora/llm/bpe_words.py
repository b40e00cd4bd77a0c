"""Byte-level BPE encoding by a table of distinct words, and decoding by a table of pieces.

Texts are split into the words of the vocabulary's own pattern, tasks reading blocks of documents. A block names each of its
distinct words once, at the word's bucket; the bucket encodes every distinct word of all blocks once, and replies to each
block with the ids in the block's order. The block's documents, kept as places of words, take the ids by position. Decoding
joins ids with the vocabulary's pieces.

The blocks are read twice, for the words and for the places. Both readings see the same rows in the same partitions, as a
scan of files gives them; a checksum of a block's words travels with its reply, and a difference stops the query. Documents
that aren't such a scan must be written first (stable=False does it).

Cases: a null or empty text has no ids; the special token's string in a text is that token; a null doc_id and repeated rows
are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import blocks, common, tokens

FILE = f"{tokens.VOCABULARY}.json"
#: Bytes of text of a block; larger blocks name fewer words.
BLOCK = 16 << 20


@functools.cache
def _splitter() -> regex.Pattern:
    # In the vocabulary's pattern \s is Unicode's White_Space.
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def split_words(text: str) -> list[str]:
    """The words that are encoded by themselves; the special token's string is one of them."""
    find = _splitter().findall
    if tokens.END_MARK not in text:
        return find(text)
    out: list[str] = []
    for k, part in enumerate(text.split(tokens.END_MARK)):
        out += [tokens.END_MARK] * (k > 0) + find(part)
    return out


@functools.cache
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path(FILE))
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def pieces() -> list[bytes]:
    """Bytes of every id."""
    out = [b""] * (tokens.END_ID + 1)
    for piece, k in tokens.ranks().items():
        out[k] = piece
    out[tokens.END_ID] = tokens.END_MARK.encode()
    return out


def _blocks(buckets: int, ask: bool):
    """With ask the blocks' distinct words by bucket, else their documents as places of words."""

    def flush(block: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        at: list[np.ndarray] = []
        for t in texts:
            at.append(np.fromiter((places.setdefault(w, len(places)) for w in split_words(t)), np.int64))
        words = [w.encode() for w in places]
        digest = blocks.digests(words)
        order = np.argsort(digest, kind="stable")
        check = int(np.bitwise_xor.reduce(digest, initial=0)).to_bytes(8, "little") + len(words).to_bytes(8, "little")
        if ask:
            edges = np.searchsorted(blocks.bucket_of(digest[order], buckets), np.arange(buckets + 1))
            rows = []
            for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if hi > lo:
                    mine = [words[k] for k in order[lo:hi]]
                    rows.append((block, b, blocks.squeeze(b"".join(mine)), blocks.pack(np.array([len(w) for w in mine])), check))
        else:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            every = np.concatenate([*at, np.zeros(0, np.int64)])
            ident = pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(a) for a in at], pa.int64())})
            rows = [(block, -1, blocks.pack(rank[every]), blocks.stream(ident), check)]
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "bucket", "data", "more", "check"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, texts) in enumerate(blocks.gathered(batches, BLOCK)):
            yield from flush(blocks.block_number(number), ids, texts)

    return run


def _encode(path: str | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Ids of one bucket's distinct words, each encoded once, in the order of each block's words."""
        known: dict[bytes, int] = {}
        where: list[np.ndarray] = []
        for data, sizes in zip(table.column("data").to_pylist(), table.column("more").to_pylist(), strict=True):
            raw, ends = blocks.unsqueeze(data), np.cumsum(blocks.unpack(sizes), dtype=np.int64).tolist()
            where.append(np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends, strict=False)), np.int64))
        words = [w.decode() for w in known]
        encode = _tokenizer(path).encode_batch
        found = [np.array(e.ids, np.uint32) for lo in range(0, len(words), 20_000) for e in encode(words[lo : lo + 20_000], add_special_tokens=False)]
        counts = np.array([len(f) for f in found], np.int64)
        flat = np.concatenate([*found, np.zeros(0, np.uint32)])
        starts = np.cumsum(counts) - counts
        ids = [flat[blocks.ragged(starts[w], counts[w])] for w in where]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array([*map(blocks.pack, ids)], pa.binary()), "more": pa.array([blocks.pack(counts[w]) for w in where], pa.binary()), "check": table.column("check")})

    return run


def _assemble(key: tuple, table: pa.Table) -> pa.Table:
    """A block's documents with their ids, and what the ids decode to."""
    table = table.sort_by("bucket")
    if len(set(table.column("check").to_pylist())) > 1 or table.column("bucket")[0].as_py() != -1:
        raise RuntimeError("the documents came in another order when they were read again; write them first")
    data, more = table.column("data").to_pylist(), table.column("more").to_pylist()
    docs = blocks.open_stream(more[0])
    every = blocks.unpack(data[0]).astype(np.int64)
    counts = np.concatenate([*(blocks.unpack(m) for m in more[1:]), np.zeros(0, np.int64)]).astype(np.int64)
    flat = np.concatenate([*(blocks.unpack(d) for d in data[1:]), np.zeros(0, np.uint32)]).astype("<u4")
    starts = np.cumsum(counts) - counts
    n = docs.column("n").to_numpy()
    ends = np.cumsum(n)
    out: list[tuple] = []
    piece = pieces()
    for lo, hi in zip(ends - n, ends, strict=True):
        ids = flat[blocks.ragged(starts[every[lo:hi]], counts[every[lo:hi]])]
        decoded = b"".join([piece[k] for k in ids.tolist()]).decode("utf-8", "replace")
        out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    columns = list(zip(*out, strict=True))
    return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(columns[0], pa.int64()), "ids_sha256": pa.array(columns[1]), "decoded_sha256": pa.array(columns[2])})


def bpe_words(docs: DataFrame, path: str | None = None, stable: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. path: the tokenizers file, the public one unless given."""
    docs = common.id_and_text(docs)
    if not stable:
        docs = common.materialize(docs, "texts")
    buckets = blocks.buckets_for(docs.count())
    schema = "block long, bucket int, data binary, more binary, check binary"
    replies = docs.mapInArrow(_blocks(buckets, True), schema).groupBy("bucket").applyInArrow(_encode(path), schema)
    mine = docs.mapInArrow(_blocks(buckets, False), schema)
    return mine.unionByName(replies).groupBy("block").applyInArrow(_assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words(common.documents(spark, sf_dir))
