"""Removal of repeated passages by suffix arrays.

Every byte is removed that lies in a string of SPAN bytes which also starts in a document with a smaller doc_id. Texts are cut
into runs of such strings by anchors: a string's anchor is its KEY bytes with the smallest hash, the first of equals, so
equal strings have equal anchors wherever they stand. A run is the longest row of strings with one anchor; its context is
the bytes that they cover, SPAN + 26 at most.

1. Blocks of documents tell how many of their documents hold each anchor, and learn which occur in other documents too.
2. Of those, blocks send each distinct context once, with the smallest doc_id that has it, to the anchor's bucket. There
   the contexts of each anchor are joined to a text, and a suffix array built by linear grouping (lyndon_suffixes.py) brings
   equal strings together; each context learns which of its strings start in a document with a smaller doc_id.
   Anchors of more than HOT documents send digests of their strings, of 128 bits by two unlike hashes, instead of contexts,
   each dealt by itself, so that no bucket gathers a passage that a third of the documents hold.
3. Blocks cover the bytes of their repeated strings.

A text of more than PART bytes is cut into parts that overlap by SPAN - 1 bytes, so that every string lies in one part; what is
covered in its parts is joined at the end.

Blocks are read once for each step, from the same files in the same order; a checksum travels with every reply, and a
difference stops the query. Documents that aren't such a scan must be written first (stable=False does it).

Cases: a null text is empty; texts shorter than SPAN keep all bytes; repeated rows of one doc_id never remove each other's
bytes; a null doc_id counts as larger than any other; an empty table gives an empty result; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import blocks, common
from vapora.llm.lyndon_suffixes import suffix_arrays

SPAN, KEY = 50, 24
#: Documents that may hold an anchor whose contexts meet in one bucket.
HOT = 200
#: Bytes of text that one block holds; its hashes take some fifty times as much memory.
BLOCK = 3 << 20
#: Bytes of a text that one block takes at most.
PART = 4 << 20
#: Places whose anchors are found at once.
PIECE = 1 << 15
#: Symbols of the texts whose suffix arrays are built at once.
BATCH = 1 << 19
_NO_ID = np.iinfo(np.int64).max
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: An anchor's place within its piece, in the low bits of what is compared.
_PLACE = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    words = np.empty(max(0, len(data) - 7), np.uint64)
    for k in range(min(8, len(words))):
        m = (len(data) - k) // 8
        words[k::8] = data[k : k + 8 * m].view("<u8")
    return words


def key_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the KEY bytes from each place on."""
    n = len(data) - KEY + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = eights(data)
    h = words[:n] * _A
    h += words[8 : n + 8] * _B
    h = _mix(h)
    h += words[16 : n + 16] * _C
    return _mix(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all keys, and for each place the place of the anchor of the string that starts there.

    Worked off in pieces that stay in a processor's cache.
    """
    n = len(data) - SPAN + 1
    if n <= 0:
        return key_hashes(data), np.zeros(0, np.int64)
    width, low = SPAN - KEY + 1, np.uint64((1 << _PLACE) - 1)
    key, anchor = np.empty(n + width - 1, np.uint64), np.empty(n, np.int64)
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        h = key_hashes(data[lo : hi + SPAN - 1])
        key[lo : lo + len(h)] = h
        h &= ~low
        h |= np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if width > span:
            h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
        h &= low
        anchor[lo:hi] = h
        anchor[lo:hi] += lo
    return key, anchor


class Runs:
    """Runs of a block: hash of the anchor, document, first string and number of strings."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.key, anchor = anchors(self.data)
        fits = self.sizes >= SPAN
        begin, end = self.starts[fits], (self.starts + self.sizes)[fits] - SPAN + 1
        new = np.zeros(len(anchor) + 1, bool)
        new[1:-1] = anchor[1:] != anchor[:-1]
        # Strings that cross into the next document aren't any.
        tails = np.r_[end, 0 * self.starts[~fits]], np.r_[np.minimum(SPAN - 1, len(anchor) - end), 0 * self.starts[~fits]]
        new[blocks.ragged(*tails)] = False
        short = blocks.ragged(self.starts[~fits], np.maximum(0, np.minimum(self.sizes[~fits], len(anchor) - self.starts[~fits])))
        new[short] = False
        new[begin] = True
        self.first = np.flatnonzero(new[:-1]) if len(anchor) else np.zeros(0, np.int64)
        holder = np.searchsorted(begin, self.first, side="right") - 1
        self.doc = np.flatnonzero(fits)[holder]
        after = np.r_[self.first[1:], len(anchor)]
        self.count = np.minimum(after, end[holder]) - self.first
        # Anchors have small hashes; mixed again they spread evenly over buckets.
        self.hash = _mix(self.key[anchor[self.first]] * _B)
        order = np.argsort(self.hash, kind="stable")
        hashes, docs = self.hash[order], self.doc[order]
        head = np.r_[True, hashes[1:] != hashes[:-1]][: len(order)]
        self.names = hashes[head]
        self.named = np.empty(len(order), np.int64)
        self.named[order] = np.cumsum(head) - 1
        another = head | np.r_[True, docs[1:] != docs[:-1]][: len(order)]
        self._holders = np.minimum(np.add.reduceat(another.astype(np.int64), np.flatnonzero(head)) if len(order) else np.zeros(0, np.int64), 255)
        self.check = int(np.bitwise_xor.reduce(self.names, initial=np.uint64(0))).to_bytes(8, "little") + len(self.data).to_bytes(8, "little")

    def holders(self) -> np.ndarray:
        """Documents that hold each name, 255 at most."""
        return self._holders

    def contexts(self, state: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of the runs with shared anchors: the runs, each one's context's number, and of each context the hash, bytes, smallest id."""
        mine = np.flatnonzero(state[self.named] == 1)
        raw = self.data.tobytes()
        numbers: dict[bytes, int] = {}
        which = np.fromiter((numbers.setdefault(raw[a : a + n + SPAN - 1], len(numbers)) for a, n in zip(self.first[mine].tolist(), self.count[mine].tolist(), strict=True)), np.int64, len(mine))
        least = np.full(len(numbers), _NO_ID)
        np.minimum.at(least, which, ids[self.doc[mine]])
        of = np.zeros(len(numbers), np.uint64)
        of[which] = self.hash[mine]
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        listed = list(numbers)
        return mine, rank[which], of[order], [listed[k] for k in order], least[order]

    def strings(self, state: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the runs with hot anchors, string by string: place, document, number of the digest; and digests in halves, smallest ids."""
        hot = np.flatnonzero(state[self.named] == 2)
        at = blocks.ragged(self.first[hot], self.count[hot])
        doc = np.repeat(self.doc[hot], self.count[hot])
        digest = _mix(_mix(self.key[at] * _A + self.key[at + KEY] * _B) + self.key[at + SPAN - KEY] * _C)
        words, other = eights(self.data), np.zeros(len(at), np.uint64)
        for k in (*range(0, SPAN - 8, 8), SPAN - 8):
            other = _mix((other ^ words[at + k]) * _C + _A)
        order = np.lexsort((other, digest))
        head, which = _distinct(digest[order], other[order])
        rank = np.empty(len(order), np.int64)
        rank[order] = which
        least = np.full(len(head), _NO_ID)
        np.minimum.at(least, rank, ids[doc])
        return at, doc, rank, digest[order][head], other[order][head], least


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows of keys the place of each distinct one, and the number of each row's."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _ids(values: list) -> np.ndarray:
    return np.array([_NO_ID if v is None else v for v in values], np.int64)


def _slices(names: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    edges = np.searchsorted(blocks.bucket_of(names, buckets), np.arange(buckets + 1))
    for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if hi > lo:
            yield b, lo, hi


def _gaps(names: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as gaps, in planes."""
    return blocks.pack(np.diff(names, prepend=np.uint64(0)))


def _ungap(raw: bytes) -> np.ndarray:
    return np.cumsum(blocks.unpack(raw).astype(np.uint64), dtype=np.uint64)


_NAMES = ["block", "bucket", "kind", "data", "more", "check"]
_KINDS = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
_ROWS = "block long, bucket int, kind string, data binary, more binary, check binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _KINDS, strict=True)], names=_NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _parts(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[list[tuple]]:
    """A task's texts in blocks of about BLOCK bytes: doc_id, bytes, the whole text's name if it is cut, and the part's offset."""
    held: list[tuple] = []
    size = wholes = 0
    for batch in common.slices(batches, "text", common.SLICE):
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            raw = raw or b""
            name = f"{blocks.block_number(wholes)}" if len(raw) > part else None
            wholes += name is not None
            for at in range(0, max(1, len(raw) - (SPAN - 1) * (name is not None)), part):
                held.append((doc_id, raw[at : at + part + SPAN - 1] if name else raw, name, at))
                size += len(held[-1][1])
                if size > BLOCK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _read(buckets: int, anchors: bool, part: int):
    """A block's anchors by bucket, or its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in enumerate(_parts(batches, part)):
            block = blocks.block_number(number)
            ids, raw, names, offsets = map(list, zip(*parts, strict=True))
            if anchors:
                runs = Runs(raw)
                holders = runs.holders()
                yield _batch([(block, b, "anchors", _gaps(runs.names[lo:hi]), blocks.pack(holders[lo:hi]), runs.check) for b, lo, hi in _slices(runs.names, buckets)])
            else:
                sizes = blocks.stream(pa.table({"doc_id": pa.array(ids, pa.int64()), "size": pa.array([len(r) for r in raw], pa.int64()), "whole": pa.array(names, pa.string()), "offset": pa.array(offsets, pa.int64())}))
                yield _batch([(block, -1, "texts", blocks.squeeze(b"".join(raw)), sizes, b"")])

    return run


def _share(hot: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """For each block's anchors: 0 if one document holds it, 1 if several do, 2 if it is hot."""
        names = [_ungap(d) for d in table.column("data").to_pylist()]
        holders = np.concatenate([blocks.unpack(m) for m in table.column("more").to_pylist()]).astype(np.int64)
        _, which = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(which, weights=holders)[which]
        state = np.where(total > hot, 2, np.where(total > 1, 1, 0))
        back = np.split(state, np.cumsum([len(n) for n in names])[:-1])
        rows = zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), back, table.column("check").to_pylist(), strict=True)
        return _table([(block, bucket, "states", blocks.pack(s), b"", check) for block, bucket, s, check in rows])

    return run


class Block:
    """A block's texts with the replies that it got."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in _NAMES), strict=True), key=lambda r: r[1])
        self.block, _, kind, texts, sizes, _ = rows[0]
        if kind != "texts":
            raise RuntimeError("the documents came in another order when they were read again; write them first")
        docs = blocks.open_stream(sizes)
        self.doc_ids = docs.column("doc_id")
        self.wholes, self.offsets = docs.column("whole").to_pylist(), docs.column("offset").to_pylist()
        self.ids = _ids(self.doc_ids.to_pylist())
        raw, ends = blocks.unsqueeze(texts), np.cumsum(docs.column("size").to_numpy())
        self.texts = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        self.runs = Runs(self.texts)
        self.replies = {kind: [r for r in rows if r[2] == kind] for kind in ("states", "contexts", "strings")}
        if any(r[5] != self.runs.check for r in self.replies["states"]):
            raise RuntimeError("the documents came in another order when they were read again; write them first")
        self.state = self.joined("states", 3)

    def joined(self, kind: str, column: int) -> np.ndarray:
        return np.concatenate([*(blocks.unpack(r[column]) for r in self.replies[kind]), np.zeros(0, np.uint8)])


def _ask(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A block's distinct contexts and hot strings, by bucket."""
        own = Block(table)
        _, _, of, contexts, least = own.runs.contexts(own.state, own.ids)
        rows = []
        for b, lo, hi in _slices(of, buckets):
            sizes = blocks.pack(np.array([len(c) for c in contexts[lo:hi]]))
            rows.append((own.block, b, "contexts", blocks.stream(pa.table({"gaps": [_gaps(of[lo:hi])], "sizes": [sizes], "bytes": [b"".join(contexts[lo:hi])]})), blocks.squeeze(least[lo:hi].tobytes()), b""))
        _, _, _, names, other, least = own.runs.strings(own.state, own.ids)
        rows += [(own.block, b, "strings", _gaps(names[lo:hi]), blocks.squeeze(least[lo:hi].tobytes()), other[lo:hi].tobytes()) for b, lo, hi in _slices(names, buckets)]
        return _table(rows)

    return run


def _least_of_strings(parts: list[bytes], ids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every string of every part, the smallest id of a part of its group that holds it; groups ascend.

    Returned are each part's first string and the ids.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    n = len(parts)
    # Symbols: bytes from 2, 1 after each part, 0 after each group.
    text = np.empty(int(sizes.sum()) + n + len(np.unique(groups)), np.int64)
    closes = np.r_[groups[1:] != groups[:-1], True]
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1 + closes[:-1]])
    text[blocks.ragged(begin, sizes)] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 2
    text[begin + sizes] = 1
    text[(begin + sizes + 1)[closes]] = 0
    heads = begin[np.r_[True, closes[:-1]]]
    order = suffix_arrays(text, heads)
    strings = sizes - SPAN + 1
    number = np.full(len(text), -1)
    number[blocks.ragged(begin, strings)] = np.arange(int(strings.sum()))
    owner = np.repeat(np.arange(n), strings)
    at = order[number[order] >= 0]
    # Strings hold no separators, so their bytes are compared, eight at once.
    words = eights((text - 2).astype(np.uint8))
    same = np.ones(max(0, len(at) - 1), bool)
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        live = np.flatnonzero(same)
        same[live] = words[at[live] + k] == words[at[live + 1] + k]
    mine = number[at]
    same &= groups[owner[mine[1:]]] == groups[owner[mine[:-1]]]
    least = np.empty(len(at), np.int64)
    if len(at):
        heads = np.flatnonzero(np.r_[True, ~same])
        least[mine] = np.repeat(np.minimum.reduceat(ids[owner[mine]], heads), np.diff(np.r_[heads, len(at)]))
    return np.cumsum(strings) - strings, least


def _judge_contexts(blocks_of: list[int], data: list[bytes], more: list[bytes]) -> list[bytes]:
    """For each block's contexts a number: bit k is set if the k-th string starts in a document with a smaller id."""
    tables = [blocks.open_stream(d) for d in data]
    of = np.concatenate([_ungap(t.column("gaps")[0].as_py()) for t in tables])
    sizes = [blocks.unpack(t.column("sizes")[0].as_py()).astype(np.int64) for t in tables]
    contexts: list[bytes] = []
    for t, s in zip(tables, sizes, strict=True):
        raw, ends = t.column("bytes")[0].as_py(), np.cumsum(s).tolist()
        contexts += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    ids = np.concatenate([np.frombuffer(blocks.unsqueeze(m), np.int64) for m in more])
    # Equal contexts are one part with their smallest id; parts of one anchor are one text.
    numbers: dict[bytes, int] = {}
    part = np.fromiter((numbers.setdefault(c, len(numbers)) for c in contexts), np.int64, len(contexts))
    least = np.full(len(numbers), _NO_ID)
    np.minimum.at(least, part, ids)
    anchor = np.zeros(len(numbers), np.uint64)
    anchor[part] = of
    listed = list(numbers)
    length = np.array([len(c) for c in listed], np.int64)
    order = np.argsort(anchor, kind="stable")
    group = np.cumsum(np.r_[True, anchor[order][1:] != anchor[order][:-1]]) - 1
    members = np.bincount(group)
    # A part alone with its anchor has no equal strings elsewhere: all of its strings have its own smallest id.
    bounds = np.r_[0, np.cumsum(members)]
    many = np.flatnonzero(members > 1)
    bulk = np.add.reduceat(length[order] + 2, bounds[:-1]) if len(order) else np.zeros(0, np.int64)
    many = many[np.argsort(bulk[many], kind="stable")]  # texts of like length side by side
    found: dict[int, np.ndarray] = {}
    batches = np.split(many, np.flatnonzero(np.diff(np.cumsum(bulk[many]) // BATCH)) + 1)
    for batch in batches:
        if len(batch):
            parts = order[blocks.ragged(bounds[batch], members[batch])]
            first, low = _least_of_strings([listed[p] for p in parts], least[parts], np.repeat(np.arange(len(batch)), members[batch]))
            cuts = [*first.tolist(), len(low)]
            found.update({int(p): low[a:b] for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)})
    strings = length - SPAN + 1
    begin = np.cumsum(strings) - strings
    low = np.repeat(least, strings)
    for p, values in found.items():
        low[begin[p] : begin[p] + strings[p]] = values
    counts = strings[part]
    smaller = low[blocks.ragged(begin[part], counts)] < np.repeat(ids, counts)
    bit = blocks.ragged(np.zeros(len(part), np.int64), counts)
    masks = np.bincount(np.repeat(np.arange(len(part)), counts), weights=smaller * np.exp2(bit), minlength=len(part)).astype(np.int64)
    return [blocks.pack(m) for m in np.split(masks, np.cumsum([len(s) for s in sizes])[:-1])]


def _judge_strings(data: list[bytes], more: list[bytes], others: list[bytes]) -> list[bytes]:
    """For each block's hot strings, whether one with the same digest starts in a document with a smaller id."""
    names = [_ungap(d) for d in data]
    ids = np.concatenate([np.frombuffer(blocks.unsqueeze(m), np.int64) for m in more])
    first, other = np.concatenate(names), np.frombuffer(b"".join(others), np.uint64)
    order = np.lexsort((other, first))
    which = np.empty(len(order), np.int64)
    which[order] = _distinct(first[order], other[order])[1]
    least = np.full(int(which.max(initial=-1)) + 1, _NO_ID)
    np.minimum.at(least, which, ids)
    return [blocks.pack(x) for x in np.split((least[which] < ids).astype(np.int64), np.cumsum([len(n) for n in names])[:-1])]


def _judge(key: tuple, table: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    kinds = np.array(table.column("kind").to_pylist())
    for kind in ("contexts", "strings"):
        mine = table.take(np.flatnonzero(kinds == kind))
        if mine.num_rows:
            block, data, more, check = (mine.column(c).to_pylist() for c in ("block", "data", "more", "check"))
            back = _judge_contexts(block, data, more) if kind == "contexts" else _judge_strings(data, more, check)
            rows += [(b, key[0].as_py(), kind, m, b"", b"") for b, m in zip(block, back, strict=True)]
    return _table(rows)


def _remove(key: tuple, table: pa.Table) -> pa.Table:
    """A block's documents without their repeated bytes."""
    own = Block(table)
    runs = own.runs
    covered = np.zeros(len(runs.data) + 1, np.int64)

    def cover(at: np.ndarray) -> None:
        covered[:] += np.bincount(at, minlength=len(covered)) - np.bincount(at + SPAN, minlength=len(covered))

    mine, which, _, contexts, least = runs.contexts(own.state, own.ids)
    masks = own.joined("contexts", 3).astype(np.int64)
    if len(masks) != len(contexts):
        raise RuntimeError("the documents came in another order when they were read again; write them first")
    n = runs.count[mine]
    k = blocks.ragged(np.zeros(len(mine), np.int64), n)
    later = own.ids[runs.doc[mine]] > least[which] if len(mine) else np.zeros(0, bool)
    gone = np.repeat(later, n) | (np.repeat(masks[which] if len(mine) else masks, n) >> k & 1).astype(bool)
    cover((np.repeat(runs.first[mine], n) + k)[gone])
    at, doc, digest, _, _, low = runs.strings(own.state, own.ids)
    if len(at):
        flags = own.joined("strings", 3).astype(bool)
        cover(at[(own.ids[doc] > low[digest]) | flags[digest]])
    gone = np.cumsum(covered[:-1]) > 0
    out: list[tuple] = []
    for text, start, whole, offset in zip(own.texts, runs.starts.tolist(), own.wholes, own.offsets, strict=True):
        cut = gone[start : start + len(text)]
        out.append((*(_without(text, cut) if whole is None else (None,) * 4), whole, offset, text if whole else None, np.packbits(cut).tobytes() if whole else None))
    columns = list(zip(*out, strict=True))
    return pa.table([own.doc_ids, *(pa.array(c, t) for c, t in zip(columns, _REMOVED_KINDS, strict=True))], names=_REMOVED_NAMES)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_REMOVED = f"{_RESULT}, whole string, offset long, raw binary, mask binary"
_REMOVED_NAMES = [c.split()[0] for c in _REMOVED.split(", ")]
_REMOVED_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())


def _without(text: bytes, cut: np.ndarray) -> tuple[int, int, int, str]:
    """Size, removed bytes, removed runs, and the digest of what is left."""
    if not cut.any():
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    spans = int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1]))
    return len(text), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~cut].tobytes()).hexdigest()


def _join_parts(key: tuple, table: pa.Table) -> pa.Table:
    """The result of one text that was cut."""
    table = table.sort_by("offset")
    offsets, raw, masks = (table.column(c).to_pylist() for c in ("offset", "raw", "mask"))
    gone = np.zeros(offsets[-1] + len(raw[-1]), bool)
    for at, part, mask in zip(offsets, raw, masks, strict=True):
        gone[at : at + len(part)] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=len(part)).astype(bool)
    text = b"".join([*(r[: b - a] for a, b, r in zip(offsets, offsets[1:], raw, strict=False)), raw[-1]])
    return pa.table([table.column("doc_id")[:1], *(pa.array([x]) for x in _without(text, gone))], names=_REMOVED_NAMES[:5])


def suffix_dedup(docs: DataFrame, stable: bool = True, hot: int = HOT, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = common.id_and_text(docs)
    if not stable:
        docs = common.materialize(docs, "texts")
    size = docs.agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("longest")).first()
    buckets = blocks.buckets_for(size["n"])
    states = common.materialize(docs.mapInArrow(_read(buckets, True, part), _ROWS).groupBy("bucket").applyInArrow(_share(hot), _ROWS), "anchor-states")
    texts = docs.mapInArrow(_read(buckets, False, part), _ROWS)
    asked = texts.unionByName(states).groupBy("block").applyInArrow(_ask(buckets), _ROWS)
    judged = common.materialize(asked.groupBy("bucket").applyInArrow(_judge, _ROWS), "repeated-strings")
    rows = texts.unionByName(states).unionByName(judged)
    removed = rows.groupBy("block").applyInArrow(_remove, _REMOVED)
    if (size["longest"] or 0) <= part:
        return removed.select(_REMOVED_NAMES[:5])
    removed = common.materialize(removed, "removed")
    cut = removed.where("whole is not null").groupBy("whole").applyInArrow(_join_parts, _RESULT)
    return removed.where("whole is null").select(_REMOVED_NAMES[:5]).unionByName(cut)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir))


ORACLE_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS (SELECT doc_id, h, unnest(range(1, greatest(1, length(h) // 2 - 48))) AS i FROM b),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 100)) AS s FROM v),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN f ON w.s = f.s AND f.least < w.doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY doc_id, k),
q AS (SELECT doc_id, list({'a': a, 'z': z} ORDER BY a) AS p, sum(z - a + 1) AS removed, count(*) AS spans FROM p GROUP BY doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN q.p IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(q.p) + 2), lambda k: substr(h, CASE WHEN k = 1 THEN 1 ELSE 2 * q.p[k - 1].z + 1 END, CASE WHEN k = len(q.p) + 1 THEN length(h) ELSE 2 * q.p[k].a - 2 END - CASE WHEN k = 1 THEN 0 ELSE 2 * q.p[k - 1].z END)), '') END)) AS kept_sha256
FROM b LEFT JOIN q ON b.doc_id = q.doc_id
"""
