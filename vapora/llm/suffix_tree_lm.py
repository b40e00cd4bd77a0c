"""Scores of texts under a probabilistic suffix tree of words.

Contexts are up to DEPTH preceding words. A context is a candidate if at least LEAST training tokens follow it, so candidates
grow with the corpus. It is retained, with its suffixes, if its next-word distribution diverges from that of its suffix:
repeated next words are taken at their share after the context against their share after the suffix, each next word's first
occurrence at the chance of a new one, and the sum must exceed GAIN nats. Distributions are smoothed from the root: a context
adds as much weight of its suffix's distribution as it has distinct next words; the root gives (c + 1) / (N + V + 1). A token
is scored in the longest retained suffix of its history.

Everything travels in packed blocks (blocks.py), dealt by 64-bit digests of the whole key, so that no word or context gathers
in one task. A block asks for its words and its pairs of a word and the next; then for two words with the next, then for longer
contexts with the next word, leaving out those whose counts follow from the shorter ones': a context with a rare part is no
candidate, and what follows a context once follows a longer one once, which only a held-out token that asked for the shorter
one must ask for. So what is asked for longer contexts is little more than what follows candidates. Contexts whose counts show
that neither they nor longer ones can pass the test (most_gain) are left out too, which changes no result: one that comes with
the same word before it nearly always says no more than its suffix. One block is told that it owns a run of words. It adds
what follows a context to the context's sums, and tells the counts and suffixes of a context that can pass; these meet at the
context's bucket. There contexts are tested and mark their suffixes at theirs, and all blocks get replies.
A run that LEAST training tokens repeat is numbered in its bucket, in the order of digests, and blocks are told. Then contexts
travel by their numbers, which lie close together, instead of digests: a block has a good part of all contexts.
Blocks and replies are written once, bucketed by the blocks' numbers, so that every reply is shuffled once whatever the rounds.

Cases: a null or empty text is the end alone; without training documents all counts are 0 and every token has the root's
probability; a null doc_id is a training document; repeated rows count as often as they occur; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import blocks, common
from vapora.llm.cross_parsing import held_out

LEAST, DEPTH, GAIN = 20, 4, 5.0
#: The key of the end token: no word holds a space.
END_KEY = b" "
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers, a place of each in x, and each number's place among them."""
    # High bits with the place in the low ones sort faster than places by numbers; what only low bits tell apart is put right after.
    bits = np.uint64(len(x).bit_length())
    high = x << bits if int(x.max(initial=0)).bit_length() + int(bits) <= 64 else x >> bits << bits
    order = (np.sort(high | np.arange(len(x), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked = x[order]
    if (ranked[1:] < ranked[:-1]).any():
        right = np.argsort(ranked, kind="stable")
        order, ranked = order[right], ranked[right]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(x), np.int64)
    where[order] = np.cumsum(new) - 1
    return ranked[new], order[new], where


def most_gain(n: np.ndarray, up: np.ndarray) -> np.ndarray:
    """What the divergence of a context with n next tokens, up after its suffix, is at most, whatever they are.

    Shares after the context are at most those that the counts allow, so the sum is largest with one distinct next word or n.
    """
    n, up = n.astype(float), up.astype(float)
    return np.maximum((n - 1) * np.log(up / (n + 1)) - np.log(n + 1), -n * np.log(2)) + 1e-6


def least_parent(least: int, gain: float) -> int:
    """Fewest tokens after a context such that a longer one with it as suffix may diverge."""
    need = lambda k: np.maximum(k, np.exp(np.minimum((gain + np.log(k + 1)) / (k - 1) + np.log(k + 1), 700)))
    first = need(float(least))
    return least if gain <= 0 or first > 1 << 16 else max(least, int(need(np.arange(least, int(first) + 2, dtype=float)).min()) - 1)


def steps_of(depth: int) -> list[list[int]]:
    """Depths of the keys that each question asks for: each needs the replies to those before."""
    return [s for s in ([0, 1], [2], list(range(3, depth + 1))) if s and s[-1] <= depth]


class Tokens:
    """A block's tokens, texts end to end, with the digests of their contexts and pairs by depth, and what replies tell."""

    def __init__(self, every: np.ndarray, digest: np.ndarray, lengths: np.ndarray, held: np.ndarray, total: int, rule: tuple[int, int, float]):
        self.depth, self.least, self.gain = rule
        self.parent, self.total, self.every = least_parent(self.least, self.gain), total, every
        self.first = np.cumsum(lengths) - lengths
        self.place = np.arange(len(every)) - np.repeat(self.first, lengths)
        self.train = ~np.repeat(held, lengths)
        self.digest, self.word = digest, digest[every]
        self.contexts = [np.zeros(len(every), np.uint64)]
        self.counts: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []
        #: Names of the runs of words that end here, as contexts: the bucket and the number there; 0 if not frequent enough.
        self.names: list[np.ndarray] = []
        #: Whether a held-out token asks for the longest key asked for so far, and whether this token does.
        self.wanted, self.open = np.zeros(len(every), bool), np.ones(len(every), bool)

    @staticmethod
    def before(a: np.ndarray, d: int) -> np.ndarray:
        """The value d tokens earlier, 0 before the first."""
        out = np.zeros_like(a)
        out[d:] = a[:-d]
        return out

    def context(self, d: int) -> np.ndarray:
        """Digests of the d words before each token."""
        for k in range(len(self.contexts), d + 1):
            self.contexts.append(mixed(self.contexts[-1] * np.uint64(0x9E3779B97F4A7C15) + self.before(self.word, k) + np.uint64(k)))
        return self.contexts[d]

    def keys(self, d: int, at: np.ndarray) -> np.ndarray:
        """Keys of tokens after the d words before them; a word's own key is odd, the others are even."""
        if d == 0:
            return self.word[at] | np.uint64(1)
        return mixed(self.context(d)[at] * np.uint64(0xD6E8FEB86659FD93) + self.word[at]) & ~np.uint64(1)

    def asked(self) -> list[tuple[int, np.ndarray]]:
        """Depths of the next question and the tokens it is about: words and pairs, then what follows ever longer candidates."""
        if not self.counts:
            return [(0, np.arange(len(self.place))), (1, np.flatnonzero(self.place >= 1))]
        # What follows a context once, in training, can matter after a longer one to a held-out token alone.
        k, out = len(self.counts) - 1, []
        may = ((self.counts[k] >= 2) | (self.counts[k] == 1) & self.wanted) & self.open & self.after(k + 1)
        for d in range(k + 1, next(s[-1] for s in steps_of(self.depth) if s[0] == k + 1) + 1):
            if d > k + 1:
                # All but the first of a context's parts belong to its suffix, which must be frequent for it to matter.
                may = may & (self.before(self.counts[k], d - k - 1) >= self.parent)
            out.append((d, np.flatnonzero(may & (self.before(self.counts[k], d - k) >= self.least) & (self.place >= d))))
        return out

    def question(self, asked: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the next question, and the place of each token's key in them."""
        parts = []
        for d, at in asked:
            if d == 0:
                # A block's words are few and known.
                found, _, where = distinct(self.digest | np.uint64(1))
                parts.append((found, where[self.every]))
            else:
                found, _, where = distinct(self.keys(d, at))
                parts.append((found, where))
        runs = np.concatenate([found for found, _ in parts] or [np.zeros(0, np.uint64)])
        # Sorted runs are merged in linear time.
        order = np.argsort(runs, kind="stable")
        ranked = runs[order]
        new = np.ones(len(runs), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        place = np.empty(len(runs), np.int64)
        place[order] = np.cumsum(new) - 1
        ends = np.cumsum([0, *(len(found) for found, _ in parts)])
        return ranked[new], np.concatenate([np.zeros(0, np.int64), *(place[lo + where] for lo, (_, where) in zip(ends[:-1], parts, strict=True))])

    def learn(self, replies: np.ndarray, names: np.ndarray | None = None) -> None:
        """Take in the counts, owners and, unless they aren't needed, names of a question's keys. A key not asked for that can matter occurs at this token alone."""
        asked = self.asked()
        where = self.question(asked)[1]
        for d, at in asked:
            mine, where = where[: len(at)], where[len(at) :]
            here = replies[mine].astype(np.int64)
            counts, owned = self.train.astype(np.int64), self.train.copy()
            counts[at], owned[at] = here >> 2, (here & 1).astype(bool) & self.train[at]
            if d < self.depth and names is not None:
                self.names.append(np.zeros(len(self.place), np.uint64))
                self.names[d][at] = names[mine]
            if d >= 1:
                self.wanted[at], self.open = here & 2 > 0, np.zeros(len(self.place), bool)
                self.open[at] = True
            if d == 1:
                counts[self.place < 1], owned[self.place < 1] = 0, False
            self.counts.append(counts)
            self.owned.append(owned)

    def followers(self, d: int) -> np.ndarray:
        """Training tokens that follow the context of d words before each token."""
        return np.where(self.place >= d, self.before(self.counts[d - 1], 1), 0) if d else np.full(len(self.place), self.total)

    def after(self, d: int) -> np.ndarray:
        """Whether a token follows a candidate of d words that may pass the test itself, or as the suffix of one."""
        n, out = self.followers(d), np.zeros(len(self.place), bool)
        at = np.flatnonzero(n >= self.least)
        n = n[at]
        out[at] = (most_gain(n, self.followers(d - 1)[at]) > self.gain) | ((n >= self.parent) if d < self.depth else False)
        return out

    def name(self, d: int) -> np.ndarray:
        """Names of the contexts of d words before each token."""
        return self.before(self.names[d - 1], 1)

    def candidates(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """By depth the tokens after candidates; names of distinct contexts of all depths, an entry of each, and each entry's context."""
        at = [np.flatnonzero(self.after(d)) for d in range(1, self.depth + 1)]
        names = np.concatenate([self.name(d)[a] for d, a in enumerate(at, 1)] or [np.zeros(0, np.uint64)])
        # Without the gap between buckets and numbers they sort faster, in the same order.
        number = names & NUMBERS
        _, entry, where = distinct((names >> NUMBER_BITS) * (number.max(initial=0) + np.uint64(1)) + number)
        return at, names[entry], entry, where


#: A name is a bucket and a number in it.
NUMBER_BITS, NUMBERS = np.uint64(36), np.uint64((1 << 36) - 1)


_ROWS = "round int, block long, bucket int, keys binary, counts binary, payload binary, tokens long, words long"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of _ROWS; tokens and words may be left out."""
    full = [(*r, *(0,) * (8 - len(r))) for r in rows]
    return pa.table({n: pa.array([r[k] for r in full], t) for k, (n, t) in enumerate(zip(_NAMES, _TYPES, strict=True))})


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Each bucket that has some of the keys, sorted by bucket, and where they are."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def _close(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, which leave high bytes empty."""
    return blocks.pack(np.diff(keys, prepend=np.uint64(0)))


def _open(raw: bytes) -> np.ndarray:
    return np.cumsum(blocks.unpack(raw), dtype=np.uint64)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of integers one after another, each with its length in front."""
    parts = [blocks.pack(c) for c in columns]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        out.append(blocks.unpack(raw[at + 4 : end]))
        at = end
    return out


def _question(step: int, block: int, tokens: Tokens, buckets: int) -> list[tuple]:
    asked = tokens.asked()
    keys, where = tokens.question(asked)
    train = np.concatenate([np.zeros(0, bool), *(tokens.train[at] for _, at in asked)])
    counts = 2 * np.bincount(where, weights=train, minlength=len(keys)).astype(np.int64)
    counts[where[~train]] |= 1
    return [(step, block, b, _close(keys[lo:hi]), blocks.pack(counts[lo:hi]), b"") for b, lo, hi in _dealt(blocks.bucket_of(keys, buckets), buckets)]


def _read():
    """Documents as blocks, a row of its tokens each (bucket -1)."""

    def flush(block: int, ids: list, held: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, int] = defaultdict(count().__next__)
        end, at = [places[END_KEY]], []
        for t in texts:
            words = t.split()
            at.append(np.fromiter(chain(map(places.__getitem__, words), end), np.int64, len(words) + 1))
        lengths, every, digest = np.array([len(a) for a in at]), np.concatenate(at), blocks.digests(list(places))
        documents = pa.table({"doc_id": pa.array(ids, pa.int64()), "held": held, "n": pa.array(lengths, pa.int64())})
        row = (0, block, -1, digest.tobytes(), blocks.pack(every), blocks.stream(documents), int(lengths[~np.array(held, bool)].sum()))
        yield from _table([row]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        ids: list = []
        held: list = []
        texts: list[bytes] = []
        for batch in common.slices(batches, "text", common.SLICE):
            for doc_id, h, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                held.append(h)
                texts.append((raw or b"").lower())
                size += len(texts[-1])
                if size > BLOCK_BYTES:
                    yield from flush(blocks.block_number(number), ids, held, texts)
                    number, size, ids, held, texts = number + 1, 0, [], [], []
        if ids:
            yield from flush(blocks.block_number(number), ids, held, texts)

    return run


def _ask_pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, tokens, _, _ = _opened(pa.Table.from_batches([batch.slice(k, 1)]), 0, (1, 2, 0.0), 0)
                yield from _table(_question(0, block, tokens, buckets)).to_batches()

    return run


def _numbers(rank: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 1, which those of other questions (three at most) don't meet."""
    return (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(4) + np.uint64(step)


def _count(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _counted(least, key, table)

    return run


def _counted(least: int, key: tuple, table: pa.Table) -> pa.Table:
    """One bucket's counts over all blocks, in each block's order: four times the count, 2 if held-out tokens ask, 1 for the owner.

    Keys that occur at least so often are ranked; the block is told the ranks of its own ones.
    """
    table = table.sort_by("block")
    keys = [_open(k) for k in table.column("keys").to_pylist()]
    mine = np.concatenate([blocks.unpack(c) for c in table.column("counts").to_pylist()]).astype(np.int64)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=mine >> 1, minlength=len(distinct)).astype(np.int64)
    wanted = np.bincount(where, weights=mine & 1, minlength=len(distinct)) > 0
    codes = (4 * total + 2 * wanted)[where]
    counted = np.flatnonzero(mine >> 1)
    codes[counted[np.unique(where[counted], return_index=True)[1]]] += 1
    ends = np.cumsum([len(k) for k in keys])[:-1]
    back, of = np.split(codes, ends), np.split(where, ends)
    frequent = total >= least
    rank = np.cumsum(frequent) - 1
    words = int(((total > 0) & (distinct & np.uint64(1) > 0)).sum())
    step, bucket = table.column("round")[0].as_py(), key[0].as_py()
    rows = [(step, b, bucket, b"", blocks.pack(c), _close(rank[w[frequent[w]]].astype(np.uint64))) for b, c, w in zip(table.column("block").to_pylist(), back, of, strict=True)]
    return _table([*rows, (step, -1, bucket, b"", b"", b"", 0, words)])


def _opened(table: pa.Table, total: int, rule: tuple[int, int, float], steps: int, named: bool = True) -> tuple[int, Tokens, pa.Table, np.ndarray]:
    """Of a block's row and its replies: its number, its tokens with the replies of the first steps, its documents, and the replies of the step after."""
    table = table.sort_by([("round", "ascending"), ("bucket", "ascending")])
    step, bucket, keys, counts, payload = (table.column(c).to_pylist() for c in ("round", "bucket", "keys", "counts", "payload"))
    at = bucket.index(-1)
    docs = blocks.open_stream(payload[at])
    tokens = Tokens(blocks.unpack(counts[at]).astype(np.int64), np.frombuffer(keys[at], np.uint64), docs.column("n").to_numpy(), docs.column("held").to_numpy(), total, rule)
    codes: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(steps + 1)]
    names: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(steps)]
    for k, b, c, ranks in zip(step, bucket, counts, payload, strict=True):
        if b >= 0 and k <= steps:
            codes[k].append(blocks.unpack(c).astype(np.int64))
            if k < steps and named:
                names[k].append(np.zeros(len(codes[k][-1]), np.uint64))
                names[k][-1][codes[k][-1] >> 2 >= tokens.least] = _numbers(_open(ranks), k) | np.uint64(b) << NUMBER_BITS
    for c, some in zip(codes, names, strict=False):
        tokens.learn(np.concatenate(c), np.concatenate(some) if named else None)
    return table.column("block")[0].as_py(), tokens, docs, np.concatenate(codes[steps])


def _ask_longer(total: int, rule: tuple[int, int, float], step: int, buckets: int):
    def run(key: tuple, mine: pa.Table) -> pa.Table:
        block, tokens, _, _ = _opened(mine, total, rule, step, named=False)
        return _table(_question(step, block, tokens, buckets))

    return run


def _ask_contexts(total: int, rule: tuple[int, int, float], buckets: int):
    depth, _, gain_least = rule
    step = len(steps_of(depth))

    def run(key: tuple, mine: pa.Table) -> pa.Table:
        """The block's candidates; of those that it owns and that may pass, counts and suffixes; of what it owns after any, the sums' shares."""
        block, tokens, _, _ = _opened(mine, total, rule, step)
        at, contexts, entry, where = tokens.candidates()
        n, up, places = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([tokens.followers(d)[a] for d, a in enumerate(at, 1)], [tokens.followers(d - 1)[a] for d, a in enumerate(at, 1)], at))
        n, up, places, deep = n[entry], up[entry], places[entry], np.repeat(np.arange(1, depth + 1), [len(a) for a in at])[entry]
        able = most_gain(n, up) > gain_least
        seen, own = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        repeated = [np.zeros((3, 0), np.int64)]
        done = 0
        for d, a in enumerate(at, 1):
            own[where[done : done + len(a)][tokens.before(tokens.owned[d - 1], 1)[a]]] = True
            here = np.flatnonzero(tokens.owned[d][a])
            here = here[distinct(tokens.keys(d, a[here]))[1]]
            m, above, of = tokens.counts[d][a[here]], tokens.counts[d - 1][a[here]], where[done + here]
            seen += np.bincount(of, minlength=len(contexts))
            again = (m > 1) & able[of]
            repeated.append(np.stack([of[again], m[again], above[again]]))
            done += len(a)
        of, m, above = np.concatenate(repeated, axis=1)
        order = np.argsort(of, kind="stable")
        m, above, times = m[order], above[order], np.bincount(of, minlength=len(contexts))
        ends = np.cumsum(np.r_[0, times])
        suffixes = [np.where(deep > k, tokens.name(k)[places], np.uint64(0)) for k in range(1, depth)]
        rows = []
        for b, lo, hi in _dealt((contexts >> NUMBER_BITS).astype(np.int64), buckets):
            mine, some = lo + np.flatnonzero((own & able)[lo:hi]), slice(ends[lo], ends[hi])
            facts = [mine - lo, n[mine], up[mine], *(x[mine] for x in suffixes)]
            shares = [seen[lo:hi], times[lo:hi], m[some], above[some]]
            rows.append((step, block, b, _close(contexts[lo:hi] & NUMBERS), _packed(facts), _packed(shares)))
        return _table(rows)

    return run


def _test(gain: float, step: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One bucket's contexts, tested (block -1), each block's places in them, and marks for suffixes of those that pass (block -2)."""
        table = table.sort_by("block")
        bucket, keys = key[0].as_py(), [_open(k) for k in table.column("keys").to_pylist()]
        contexts, where = np.unique(np.concatenate(keys), return_inverse=True)
        begins = np.cumsum([0, *map(len, keys)])[:-1]
        facts, shares = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("counts", "payload"))
        owned = where[np.concatenate([t[0].astype(np.int64) + o for t, o in zip(facts, begins, strict=True)])]
        column = lambda ts, k: np.concatenate([t[k].astype(np.uint64) for t in ts])
        # Contexts without counts can't pass.
        n, up = np.full(len(contexts), np.nan), np.full(len(contexts), np.nan)
        n[owned], up[owned] = column(facts, 1), column(facts, 2)
        t = np.bincount(where, weights=column(shares, 0), minlength=len(contexts))
        m, above = column(shares, 2).astype(float), column(shares, 3).astype(float)
        repeated = np.bincount(np.repeat(where, column(shares, 1).astype(np.int64)), weights=(m - 1) * (np.log(m) - np.log(above)), minlength=len(contexts))
        better = repeated - (n - t) * (np.log(n + t) - np.log(up)) + t * np.log(t / (n + t))
        passes = better > gain
        marks = np.unique(np.concatenate([np.zeros(0, np.uint64), *(column(facts, k)[passes[owned]] for k in range(3, len(facts[0])))]))
        marks = marks[marks > 0]
        rows = [(step, -1, bucket, _close(contexts), blocks.pack(2 * t.astype(np.int64) + passes), b"")]
        places = np.split(where, np.cumsum([len(k) for k in keys])[:-1])
        rows += [(step, b, bucket, b"", _close(w.astype(np.uint64)), b"") for b, w in zip(table.column("block").to_pylist(), places, strict=True)]
        return _table(rows + [(step, -2, b, _close(marks[lo:hi] & NUMBERS), b"", b"") for b, lo, hi in _dealt((marks >> NUMBER_BITS).astype(np.int64), buckets)])

    return run


def _retain(key: tuple, table: pa.Table) -> pa.Table:
    """Replies about contexts: twice the distinct next words and 1 if retained, else 0."""
    block, keys, counts = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
    at = block.index(-1)
    marked = np.concatenate([np.zeros(0, np.uint64), *(_open(k) for b, k in zip(block, keys, strict=True) if b == -2)])
    codes = blocks.unpack(counts[at]).astype(np.int64) | np.isin(_open(keys[at]), marked)
    codes[codes & 1 == 0] = 0
    return _table([(table.column("round")[0].as_py(), b, key[0].as_py(), b"", blocks.pack(codes[_open(c).astype(np.int64)]), b"") for b, c in zip(block, counts, strict=True) if b >= 0])


def _finish(total: int, words: int, rule: tuple[int, int, float]):
    def run(key: tuple, mine: pa.Table) -> pa.Table:
        _, tokens, docs, replies = _opened(mine, total, rule, len(steps_of(rule[0])))
        at, _, _, where = tokens.candidates()
        known, n, first = tokens.counts[0], docs.column("n").to_numpy(), tokens.first
        p = (known + 1.0) / (total + words + 1.0)
        root = np.log10(p)
        codes = replies[where]
        for d, a in enumerate(at, 1):
            here, codes = codes[: len(a)], codes[len(a) :]
            a, t = a[here & 1 > 0], (here >> 1)[here & 1 > 0]
            p[a] = (tokens.counts[d][a] + t * p[a]) / (tokens.followers(d)[a] + t)
        add = lambda w: np.add.reduceat(w, first) if len(n) else w
        elsewhere = (tokens.counts[1] > tokens.train) & (tokens.place >= 1)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held"), "n_tokens": docs.column("n"),
            "n_known": pa.array(add((known > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(n), total, np.int64)),
            "base_score": pa.array(add(root)), "score": pa.array(add(np.log10(p))), "pair_share": pa.array(add(elsewhere.astype(float)) / n),
        })

    return run


def suffix_tree_scores(docs: DataFrame, folds: int = 7, fold: int = 2, least: int = LEAST, gain: float = GAIN, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, pair_share; least is 2 or more.

    pair_share is the share of tokens that follow the word before them at another place of the training texts too.
    """
    docs = common.id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    buckets = blocks.buckets_for(docs.count())
    mine = common.bucketed(docs.mapInArrow(_read(), _ROWS), "block", "word-blocks", last=False)
    total = mine.agg(F.sum("tokens")).first()[0] or 0
    add = lambda more, last=False: common.bucketed(more, "block", "word-blocks", mine, last)
    known = add(mine.mapInArrow(_ask_pairs(buckets), _ROWS).groupBy("bucket").applyInArrow(_count(least), _ROWS))
    words = known.agg(F.sum("words")).first()[0] or 0
    by_block = lambda r: r.where("block >= 0").groupBy("block")
    rule, steps = (depth, least, gain), len(steps_of(depth))
    for step in range(1, steps):
        longer = by_block(known).applyInArrow(_ask_longer(total, rule, step, buckets), _ROWS)
        known = add(longer.groupBy("bucket").applyInArrow(_count(least), _ROWS))
    contexts = by_block(known).applyInArrow(_ask_contexts(total, rule, buckets), _ROWS)
    tested = contexts.groupBy("bucket").applyInArrow(_test(gain, steps, buckets), _ROWS)
    retained = tested.groupBy("bucket").applyInArrow(_retain, _ROWS)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, pair_share double"
    return by_block(add(retained, last=True)).applyInArrow(_finish(total, words, rule), schema)


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(common.documents(spark, sf_dir))
