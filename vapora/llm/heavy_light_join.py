"""Jaccard self-join of word n-gram sets, light sets by subsets and heavy sets by inverted lists.

Documents with equal sets form a class, and the join is between classes. Two sets of sizes a and b have similarity 0.75 or
more when they share at least need(a, b) shingles. A light set (up to `boundary` shingles) lists each of its subsets of the
sizes that its possible partners need: two light sets with a common subset of that size are linked. A heavy set and any set
that may be linked with one stand in the inverted lists of their first shingles, as many as it takes for linked sets to share
one. Shingles are ordered by a sketch of their frequency, so that shared passages come last. The boundary is the size at which
the subsets' cost, over the counted sizes of all classes, exceeds that of the lists, each entry of which is tested with as many
others as a shingle of that frequency has, or with pivots and hubs alone where the list is long.

What meets by a subset or in a list is a candidate, tested on the whole sets. A list of up to SHORT classes gives all of its pairs; a longer
one first links its classes with PIVOTS of them, then with HUBS of its largest component. Only then are its pairs tested that lie in different components,
so a large group of near copies never gives all of its pairs, and no link between components is lost.

Cases: a null, empty or blank text has the empty set and is linked with nothing; a text of fewer than N words has one shingle;
repeated rows and ties share a class; a null doc_id is linked like others but never the smallest; an empty table gives an
empty result. Within a pair shingles are told apart by 64-bit hashes. Sets of one class have equal hashes of 127 bits: where
the 63 bits that name a class don't suffice, which is looked for, the lists are made again with other names for its sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import blocks, common, graph

#: Words of a shingle; similarity as a fraction.
N, SIMILAR, OF = 5, 75, 100
#: Counters of the frequency sketch; classes of a list that are all paired, and pivots of a longer one; members tested at once.
SKETCH_BITS, SHORT, PIVOTS, TESTED = 22, 12, 1, 256
#: Members of a list's largest component that the others are first tested with, and how often before all pairs are.
HUBS, TURNS = 8, 3
#: What finds a document again; null ids share one.
MARK = "xxhash64(doc_id)"
#: Largest size whose costs are weighed; subsets of larger sets are far too many.
LIGHT_MOST = 20
#: Members in a row of a long list.
LISTED = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def need(a: int, b: int) -> int:
    """Least common shingles of linked sets of sizes a and b."""
    return -(-SIMILAR * (a + b) // (SIMILAR + OF))


def partners(a: int) -> range:
    """Sizes of sets that a set of size a can be linked with."""
    return range(-(-SIMILAR * a // OF), OF * a // SIMILAR + 1)


def prefix_length(a: np.ndarray | int):
    """Shingles of a set of size a of which any linked set holds one among its own."""
    return a - -(-SIMILAR * a // OF) + 1


def subset_sizes(a: int, most: int) -> list[int]:
    """Subset sizes that a light set lists for its light partners."""
    return sorted({need(a, b) for b in partners(a) if 1 <= b <= most})


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def shingles(raw: bytes, n: int = N, cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of a lower-cased text's shingles."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    cache = {} if cache is None else cache
    get, digest = cache.get, xxhash.xxh3_64_intdigest
    h = np.fromiter([get(w) or cache.setdefault(w, digest(w) or 1) for w in words], np.uint64, len(words))
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = _mix(total * _ODD + h[k : len(words) - width + k + 1])
    return np.unique(total + np.uint64(width))


def set_digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1  # fits a signed number


class Names:
    """Names of classes: the first bits of the sets' digests, but another digest for sets of names that several sets bear."""

    def __init__(self, bits: int, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = bits, shared

    def of(self, s: np.ndarray) -> tuple[int, int]:
        """A set's name, and a check of 64 bits that sets of one name share."""
        name, check = set_digest(s) >> (63 - self.bits), xxhash.xxh64_intdigest(s.tobytes())
        if name in self.shared:
            name = xxhash.xxh3_64_intdigest(check.to_bytes(8, "little"), seed=name) >> 1
        return name, check - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray, int, bytes]]:
    cache: dict[bytes, int] = {}
    for batch in common.slices(batches, "text", common.SLICE):
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if len(cache) > 200_000:
                cache.clear()
            s = shingles(raw or b"", cache=cache)
            yield doc_id, s, set_digest(s), raw or b""


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters in chunks, and at chunk -1 its counts of sizes up to LIGHT_MOST; each class once."""
    counters = np.zeros(1 << SKETCH_BITS, np.uint32)
    sizes = np.zeros(LIGHT_MOST + 1, np.int64)
    seen: set[int] = set()
    held: list[np.ndarray] = []
    n = 0

    def add() -> None:
        if held:
            np.add(counters, np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters)).astype(np.uint32), out=counters)

    for _, s, d, _ in _sets(batches):
        if len(s) and d not in seen:
            seen.add(d)
            held.append(s)
            n += len(s)
            if len(s) <= LIGHT_MOST:
                sizes[len(s)] += 1
            if n > 500_000:
                add()
                held, n = [], 0
    add()
    chunks = np.split(counters, 64)
    yield pa.RecordBatch.from_arrays([pa.array([*range(64), -1], pa.int32()), pa.array([*map(blocks.pack, chunks), blocks.pack(sizes)], pa.binary())], names=["chunk", "counters"])


def _sum_sketch(key: tuple, table: pa.Table) -> pa.Table:
    total = 0
    for raw in table.column("counters").to_pylist():
        total = total + blocks.unpack(raw).astype(np.int64)
    if key[0].as_py() >= 0:
        total = np.rint(8 * np.log2(total + 1))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counters": [blocks.pack(np.asarray(total, np.int64))]})


def usual_length(sketch: np.ndarray) -> float:
    """Members of the lists that sets stand in: occurrences of shingles in the rarer quarter of all occurrences, at its middle."""
    counts = np.sort(np.exp2(sketch / 8) - 1)
    mass = np.cumsum(counts)
    return float(counts[np.searchsorted(mass, mass[-1] / 8)]) if len(mass) and mass[-1] else 1.0


def tests_of_entry(length: float) -> float:
    """Members that an entry of a list of that length is tested with."""
    return min(length, SHORT + PIVOTS + HUBS * TURNS)


def choose_boundary(sizes: np.ndarray, scan: float) -> int:
    """The boundary of the least cost: subsets that light sets list, against lists' entries each scanned `scan` times."""
    costs = [0.0]
    for most in range(1, LIGHT_MOST + 1):
        light = sum(int(sizes[a]) * sum(comb(a, c) for c in subset_sizes(a, most)) for a in range(1, most + 1))
        lists = sum(int(sizes[a]) * int(prefix_length(a)) * (1 + scan) for a in range(1, LIGHT_MOST + 1) if partners(a)[-1] > most)
        costs.append(light + lists)
    costs[0] = sum(int(sizes[a]) * int(prefix_length(a)) * (1 + scan) for a in range(1, LIGHT_MOST + 1))
    return int(np.argmin(costs))


def _entries(s: np.ndarray, order: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set's list entries; the subset size of each, 0 for a shingle's list; the set's shingles from the listed one on."""
    keys: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    rests: list[np.ndarray] = []
    a = len(s)
    if a <= boundary:
        for c in subset_sizes(a, boundary):
            subsets = np.array(list(itertools.combinations(s.tolist(), c)), np.uint64)
            h = np.full(len(subsets), c, np.uint64)
            for k in range(c):
                h = _mix(h * _ODD + subsets[:, k])
            keys.append(h)
            kinds.append(np.full(len(h), c))
            rests.append(np.full(len(h), a))
    if partners(a)[-1] > boundary:
        rank = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        # Of equal ranks by another hash, so that what is listed spreads evenly over buckets.
        first = np.lexsort((_mix(s * _ODD), rank))[: int(prefix_length(a))]
        keys.append(s[first])
        kinds.append(np.zeros(len(first), np.int64))
        rests.append(a - np.arange(len(first)))
    return np.concatenate(keys), np.concatenate(kinds), np.concatenate(rests)


_POSTED = "bucket int, keys binary, kinds binary, rests binary, class binary, size binary, ids binary"


def _post(shared, boundary: int, buckets: int, names: Names):
    """List entries by bucket, each class once a block; at bucket -1 the block's documents."""

    def flush(docs: list, sets: list) -> Iterator[pa.RecordBatch]:
        order = shared.value
        ident = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "n_shingles": pa.array([d[1] for d in docs], pa.int64()), "class": pa.array([d[2] for d in docs], pa.int64()), "check": pa.array([d[3] for d in docs], pa.int64())})
        rows = [(-1, b"", b"", b"", b"", b"", blocks.stream(ident))]
        if sets:
            parts = [_entries(s, order, boundary) for s, _ in sets]
            counts = [len(p[0]) for p in parts]
            keys, kinds, rests = (np.concatenate(p) for p in zip(*parts, strict=True))
            owner = np.repeat(np.array([d for _, d in sets], np.int64), counts)
            size = np.repeat(np.array([len(s) for s, _ in sets]), counts)
            sort = np.argsort(keys, kind="stable")
            keys, kinds, rests, owner, size = keys[sort], kinds[sort], rests[sort], owner[sort], size[sort]
            edges = np.searchsorted(blocks.bucket_of(keys, buckets), np.arange(buckets + 1))
            rows += [(b, np.diff(keys[lo:hi], prepend=keys[lo] * 0).tobytes(), blocks.pack(kinds[lo:hi]), blocks.pack(rests[lo:hi]), owner[lo:hi].tobytes(), blocks.pack(size[lo:hi]), b"") for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["bucket", "keys", "kinds", "rests", "class", "size", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        sets: list = []
        seen: set[int] = set()
        n = 0
        for doc_id, s, _, _ in _sets(batches):
            d, check = names.of(s) if len(s) else (None, None)
            docs.append((doc_id, len(s), d, check))
            if len(s) and d not in seen:
                seen.add(d)
                sets.append((s, d))
                n += len(s)
            if n > 1_000_000 or len(docs) > 100_000:
                yield from flush(docs, sets)
                docs, sets, n = [], [], 0
        if docs:
            yield from flush(docs, sets)

    return run


_FOUND = "kind string, a long, b long, part int, list binary"


def may_link(size_a: np.ndarray, rest_a: np.ndarray, size_b: np.ndarray, rest_b: np.ndarray) -> np.ndarray:
    """Whether sets may be linked whose first common shingle has rest_a and rest_b of their shingles from it on.

    If the listed shingle isn't the first common one, that one's list decides.
    """
    return (SIMILAR + OF) * np.minimum(rest_a, rest_b) >= SIMILAR * (size_a + size_b)


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket's subsets and lists: candidate pairs, and the long lists that are still to be finished."""
    cols = {c: table.column(c).to_pylist() for c in ("keys", "kinds", "rests", "class", "size")}
    keys = np.concatenate([np.cumsum(np.frombuffer(k, np.uint64)) for k in cols["keys"]])
    kinds, rests, size = (np.concatenate([blocks.unpack(k) for k in cols[c]]).astype(np.int64) for c in ("kinds", "rests", "size"))
    owner = np.concatenate([np.frombuffer(k, np.int64) for k in cols["class"]])
    order = np.lexsort((owner, size, kinds, keys))
    keys, kinds, rests, owner, size = keys[order], kinds[order], rests[order], owner[order], size[order]
    again = np.r_[False, (keys[1:] == keys[:-1]) & (kinds[1:] == kinds[:-1]) & (owner[1:] == owner[:-1])]
    keys, kinds, rests, owner, size = keys[~again], kinds[~again], rests[~again], owner[~again], size[~again]
    edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]), True])
    many = np.flatnonzero(np.diff(edges) > 1)
    pairs: list[np.ndarray] = []
    long: dict[int, np.ndarray] = {}
    for k in many:
        lo, hi = edges[k], edges[k + 1]
        who, sizes, rest, c = owner[lo:hi], size[lo:hi], rests[lo:hi], kinds[lo]
        if c:  # all that fit the smallest are linked with it, and so with one another
            fits = (SIMILAR + OF) * c >= SIMILAR * (sizes + sizes[0])
            fits[0] = False
            pairs.append(np.stack([np.full(fits.sum(), who[0]), who[fits]], 1))
        elif hi - lo <= SHORT:
            i, j = np.triu_indices(hi - lo, 1)
            near = may_link(sizes[i], rest[i], sizes[j], rest[j])
            pairs.append(np.stack([who[i[near]], who[j[near]]], 1))
        else:
            for p in range(PIVOTS):
                hub = int(np.argmin(_mix(who.astype(np.uint64) * _ODD + np.uint64(p))))
                near = may_link(sizes, rest, sizes[hub], rest[hub]) & (who != who[hub])
                pairs.append(np.stack([np.full(near.sum(), who[hub]), who[near]], 1))
            # Those that may be linked with anyone of the list.
            open_ = np.flatnonzero((SIMILAR + OF) * rest >= SIMILAR * (sizes + np.maximum(sizes[0], -(-SIMILAR * sizes // OF))))
            if len(open_) > 1:
                members = np.stack([who[open_], sizes[open_], rest[open_]], 1).astype(np.int64)
                long[set_digest(members)] = members
    p = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0)
    rows = [(number, k, m[lo : lo + LISTED].tobytes()) for number, m in long.items() for k, lo in enumerate(range(0, len(m), LISTED))]
    tested = pa.table({"kind": pa.array(["test"] * len(p), pa.string()), "a": p[:, 0], "b": p[:, 1], "part": pa.nulls(len(p), pa.int32()), "list": pa.nulls(len(p), pa.binary())})
    number, part, raw = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.concat_tables([tested, pa.table({"kind": pa.array(["long"] * len(rows), pa.string()), "a": pa.array(number, pa.int64()), "b": pa.nulls(len(rows), pa.int64()), "part": pa.array(part, pa.int32()), "list": pa.array(raw, pa.binary())})])


def _texts(names: Names):
    """Classes and texts of documents, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches, "text", common.SLICE):
            rows = {}
            for _, s, _, raw in _sets(iter([batch])):
                d = names.of(s)[0] if len(s) else None
                if len(s) and d not in seen:
                    seen.add(d)
                    rows[d] = blocks.squeeze(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["class", "text"])

    return run


def _test(key: tuple, table: pa.Table) -> pa.Table:
    """Links of one hub with the members of one salt."""
    hub = key[0].as_py()
    cache: dict[bytes, int] = {}
    mine, links = None, []
    rows = zip(table.column("member").to_pylist(), table.column("text").to_pylist(), strict=True)
    for member, text in sorted(rows, key=lambda r: r[0] != hub):
        s = shingles(blocks.unsqueeze(text), cache=cache)
        if member == hub:
            mine = s
        elif mine is not None:
            both = len(np.intersect1d(mine, s, assume_unique=True))
            if OF * both >= SIMILAR * (len(mine) + len(s) - both):
                links.append(member)
    return pa.table({"a": pa.array([hub] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})


def tested(docs: DataFrame, holders: DataFrame, pairs: DataFrame, names: Names) -> DataFrame:
    """Those of the pairs (a hub, b member) of classes whose sets are linked. holders: class, mark of one of its documents."""
    pairs = common.materialize(pairs.select("a", "b").distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = common.Filter(common.materialize(asked.join(holders, "class").select("mark"), "marks"), "mark")
    chosen = wanted.mark(docs.select("doc_id", "text"), F.expr(MARK), "chosen").where("chosen").select("doc_id", "text")
    texts = chosen.mapInArrow(_texts(names), "class long, text binary").join(asked, "class", "left_semi")
    texts = texts.groupBy("class").agg(F.min("text").alias("text"))
    salts = pairs.groupBy("a").agg((1 + F.count("*") / TESTED).cast("int").alias("salts"))
    dealt = common.materialize(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt")), "dealt-pairs")
    rows = dealt.select("a", "salt", F.col("b").alias("class")).unionByName(dealt.select("a", "salt", F.col("a").alias("class")).distinct())
    rows = rows.join(texts, "class").select("a", "salt", F.col("class").alias("member"), "text")
    return common.materialize(rows.groupBy("a", "salt").applyInArrow(_test, "a long, b long"), "links")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, raw in zip(batch.column("number").to_pylist(), batch.column("list").to_pylist(), strict=True):
            a = np.frombuffer(raw, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), number)), *(pa.array(np.ascontiguousarray(c)) for c in a.T)], names=["number", "class", "size", "rest"])


class Unfinished:
    """Members of the long lists, and what is left to test once the components of the links so far are known."""

    def __init__(self, long: DataFrame):
        lists = long.select(F.col("a").alias("number"), "part", "list").dropDuplicates(["number", "part"])
        self.all = common.materialize(lists.mapInArrow(_members, "number long, class long, size long, rest long"), "members")

    def open_members(self, labels: DataFrame) -> DataFrame:
        """Members of lists with more than one component, with their label and main, the label of the list's largest one."""
        members = self.all.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        parts = members.groupBy("number", "label").agg(F.count("*").alias("n"))
        main = parts.groupBy("number").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("parts > 1")
        return common.materialize(members.join(main, "number"), "open-members")

    @staticmethod
    def _fit(one: DataFrame, other: DataFrame) -> DataFrame:
        one = one.select("number", F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("rest").alias("rest_a"), F.col("label").alias("label_a"))
        fits = (F.least("rest", "rest_a") * (SIMILAR + OF) >= (F.col("size") + F.col("size_a")) * SIMILAR) & (F.col("label") != F.col("label_a"))
        return one.join(other, "number").where(fits).select("a", F.col("class").alias("b")).distinct()

    def with_hubs(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs of HUBS members of each list's largest component, others each turn, with all members outside of it."""
        order = [F.struct(F.xxhash64("class", F.lit(turn * HUBS + k)).alias("o"), "class") for k in range(HUBS)]
        hubs = members.where("label = main").groupBy("number").agg(F.array_distinct(F.array(*(F.min_by("class", o) for o in order))).alias("hubs"))
        hubs = hubs.select("number", F.explode("hubs").alias("class")).join(members, ["number", "class"])
        return self._fit(hubs, members.where("label <> main"))

    def rest(self, members: DataFrame) -> DataFrame:
        """Pairs of everyone outside a list's largest component with everyone of another one."""
        return self._fit(members.where("label <> main"), members)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            yield from blocks.open_stream(raw).to_batches()


def ngram_components(docs: DataFrame, name_bits: int = 63) -> DataFrame:
    """doc_id, n_shingles, component_id. name_bits: bits of the names of classes, before those that clash are told apart."""
    spark = docs.sparkSession
    docs = common.id_and_text(docs)
    sketch = docs.mapInArrow(_sketch, "chunk int, counters binary").groupBy("chunk").applyInArrow(_sum_sketch, "chunk int, counters binary").collect()  # 4 M counters, whatever the input
    by = {r["chunk"]: blocks.unpack(bytes(r["counters"])) for r in sketch}
    order = np.concatenate([by[k] for k in range(64)]).astype(np.uint8) if by else np.zeros(1 << SKETCH_BITS, np.uint8)
    boundary = choose_boundary(by.get(-1, np.zeros(LIGHT_MOST + 1, np.int64)), tests_of_entry(usual_length(order)))
    shared, names, buckets = spark.sparkContext.broadcast(order), Names(name_bits), blocks.buckets_for(docs.count())
    while True:
        posted = common.materialize(docs.mapInArrow(_post(shared, boundary, buckets, names), _POSTED), "lists")
        rows = posted.where("bucket = -1").select("ids").mapInArrow(_documents, "doc_id long, n_shingles long, class long, check long")
        # Of n sets n * n / 2 ** 64 share a name with another: none, or some hundreds of a hundred billion.
        clashing = rows.where("class is not null").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("class").collect()
        if not clashing:
            break
        names = Names(name_bits, names.shared | {r["class"] for r in clashing})
    found = common.materialize(posted.where("bucket >= 0").drop("ids").groupBy("bucket").applyInArrow(_meet, _FOUND), "found")
    holders = rows.where("class is not null").groupBy("class").agg(F.min(F.expr(MARK)).alias("mark"))
    links = tested(docs, holders, found.where("kind = 'test'"), names)
    long = found.where("kind = 'long'")
    labels = graph.components(links)
    if not long.isEmpty():
        left = Unfinished(long)
        members = left.open_members(labels)
        for turn in range(TURNS):
            size = members.groupBy("number").agg(F.first("n_all").alias("n_all"), F.first("n_main").alias("n_main")).agg(F.sum("n_all"), F.sum((F.col("n_all") - F.col("n_main")) * F.col("n_all"))).first()
            if (size[1] or 0) <= 4 * HUBS * (size[0] or 0):  # hardly more pairs than members
                break
            links = links.unionByName(tested(docs, holders, left.with_hubs(members, turn), names))
            labels = graph.components(links)
            members = left.open_members(labels)
        more = tested(docs, holders, left.rest(members), names)
        if not more.isEmpty():
            labels = graph.components(links.unionByName(more))
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = common.materialize(classes.select("class", "label").join(least, "label").select("class", "component_id"), "components")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) > 4 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS s FROM l),
n AS (SELECT doc_id, len(s) AS n FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
g AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
