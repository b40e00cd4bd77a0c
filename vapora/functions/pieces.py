"""Pieces of texts as numbers: at most eight bytes of UTF-8, filled up with zeros, so that all pieces of many texts are masks of one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the longest piece.
LONGEST = 8
#: The last byte of the key of a text of one letter, which is found as a whole; UTF-8 has no such byte.
WHOLE = 0xFF


def key(piece: bytes) -> int:
    """A piece as a signed number."""
    return int.from_bytes(piece.ljust(LONGEST, b"\0"), "big", signed=True)


def whole_key(letter: bytes) -> int:
    return key(letter.ljust(LONGEST - 1, b"\0") + bytes([WHOLE]))


def spread(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of texts: the eight bytes from each place on, the bytes left there of its text, the list it is of, and the first places of texts."""
    flat, of = texts.flatten(), pc.list_parent_indices(texts).to_numpy()
    if flat.null_count:
        of, flat = of[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = flat.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    lengths = np.diff(ends)
    if not lengths.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.zeros(ends[-1] - ends[0] + LONGEST, np.uint8)
    raw[:-LONGEST] = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ahead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, LONGEST)[:-1]).view(">u8").ravel().astype(np.uint64)
    starts = ends[:-1] - ends[0]
    rest = np.repeat(starts + lengths, lengths) - np.arange(len(ahead))
    return ahead, rest, np.repeat(of, lengths), starts[lengths > 0]


def _mask(size: int) -> np.uint64:
    return np.uint64(((1 << 8 * size) - 1) << 8 * (LONGEST - size))


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte (from 65,536 on) and pair of bytes occurs in a task's column sought."""
    counts = np.zeros(65_536 + 256, np.int64)
    for batch in batches:
        ahead, rest, _, _ = spread(batch.column("sought"))
        counts[:65_536] += np.bincount((ahead[rest >= 2] >> np.uint64(48)).astype(np.int64), minlength=65_536)
        counts[65_536:] += np.bincount((ahead >> np.uint64(56)).astype(np.int64), minlength=256)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["pair", "n"])


def shares(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logarithms of counts, minus infinity where a pair doesn't occur."""
    out = np.full(65_536 + 256, -np.inf)
    out[pair] = np.log(n / max(1, n.max(initial=1)))
    return out


def rarest(text: bytes, share: np.ndarray) -> int | None:
    """The key of the piece of a text that seems rarest by its pairs of bytes; None where the text has a pair that doesn't occur."""
    of = np.frombuffer(text, np.uint8).astype(np.int64)
    each = share[of[:-1] * 256 + of[1:]] if len(of) > 1 else share[of + 65_536]
    if np.isinf(each).any():
        return None
    size = min(LONGEST, len(text))
    sums = np.cumsum(np.concatenate([[0.0], each]))
    width = max(1, size - 1)
    at = int(np.argmin(sums[width:] - sums[:-width]))
    return key(text[at : at + size])


class Wanted:
    """Keys that are looked for, sorted, and a table of bits of their digests that turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(np.int64).view(np.uint64))
        self.shift = np.uint64(64 - min(26, max(10, (16 * len(keys)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        keys = keys ^ (keys >> np.uint64(29))  # short pieces are zeros at their low end
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that are wanted."""
        may = np.flatnonzero(self.table[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[may])
        return may[self.keys[np.minimum(at, len(self.keys) - 1)] == keys[may]] if len(self.keys) else may[:0]


def met(keep: list[str], wanted: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kept columns and met, the distinct keys of the texts in sought: those that are wanted, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None if (some := wanted()) is None else Wanted(some)
        for batch in batches:
            ahead, rest, of, starts = spread(batch.column("sought"))
            places, keys = [], []
            for size in range(1, LONGEST + 1):
                at = np.flatnonzero(rest >= size)
                pieces = ahead[at] & _mask(size)
                hit = slice(None) if look is None else look.among(pieces)
                places.append(of[at[hit]])
                keys.append(pieces[hit])
            short = starts[rest[starts] <= 4]  # a letter has four bytes at most
            size = rest[short].astype(np.uint64)
            pieces = ahead[short] & (~np.uint64(0) << (np.uint64(64) - np.uint64(8) * size)) | np.uint64(WHOLE)
            hit = slice(None) if look is None else look.among(pieces)
            rows, found = np.concatenate([*places, of[short[hit]]]), np.concatenate([*keys, pieces[hit]])
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
            rows, found = rows[new], found[new]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=batch.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "met"])

    return run
