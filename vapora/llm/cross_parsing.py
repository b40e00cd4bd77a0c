"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled sample holds all of its substrings. A text is parsed with it into phrases,
each the longest match from where the last one ended. A phrase costs a place in the sample and a symbol, log2(sample) + 8
bits, which makes samples of different lengths comparable; the language that needs the fewest bits wins, and the score is how
far it lies below the second.

Every language that labels a document is learned. The sample of a language is bounded: SAMPLE characters, of up to SLICE_OF
from the middle of each of its distinct texts, in the order of the texts' hashes. Texts are read as lower-case letters in
UTF-8, anything else as a space. Languages are parsed AT_ONCE at a time, in as many passes as it takes; a numpy step moves
thousands of segments by one byte, and the states at their ends are carried on.

Cases: a null text and one without a letter are `und` with score 0; without any labelled document every text is `und`; ties
go to the language first in order; a null doc_id is not held out; repeated rows are judged alike, and count once in a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.llm import common, lockstep

SAMPLE, SLICE_OF, SEGMENT, AT_ONCE = 16_000, 1_000, 1024, 8
UNKNOWN = "und"
#: Bytes of text that are parsed at once.
SLICE = 4 << 20


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "US-ASCII")) % folds == fold, F.lit(False))


def letters() -> np.ndarray:
    """By code point: its lower-case letter's code point, or 32."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low[0])
    return table


_LETTERS: list[np.ndarray] = []


def read(text: str) -> bytes:
    """The text's lower-case letters, and a space for each other character, in UTF-8."""
    if not _LETTERS:
        _LETTERS.append(letters())
    return _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype("<u4").tobytes().decode("utf-32-le", "replace").encode()


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return edges


def parser_table(edges: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """The automaton as a parser: the next state, and 1 where the symbol begins a phrase because the match ends before it."""
    root = np.zeros(alphabet, np.int32)
    for c, to in edges[0].items():
        root[c] = to
    following = np.tile(root, (len(edges), 1))
    begins = np.ones((len(edges), alphabet), np.uint8)
    for state, out in enumerate(edges):
        for c, to in out.items():
            following[state, c] = to
            begins[state, c] = state == 0
    return following, begins


def sample(docs: DataFrame) -> dict[str, bytes]:
    """By language the bytes of its sample; SAMPLE / SLICE_OF slices and those of the shortest texts reach the driver, for each language."""
    labelled = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    middle = F.substring("text", F.greatest(F.lit(1), (F.length("text") - SLICE_OF) / 2 + 1).cast("int"), F.lit(SLICE_OF))
    known = labelled.select("lang", F.xxhash64("text").alias("h"), middle.alias("slice")).where(F.col("slice").rlike(r"\p{L}"))
    # A share of the hashes in which a language should find its sample eight times; copies may take more of them.
    size = labelled.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(SLICE_OF))).alias("all"))
    shares = {r["lang"]: min(1.0, 8 * SAMPLE / max(1, r["all"])) for r in size.collect()}
    spark, out = docs.sparkSession, {}
    while shares:
        wanted = F.broadcast(spark.createDataFrame(list(shares.items()), "lang string, share double"))
        near = known.join(wanted, "lang").where(F.pmod("h", F.lit(1 << 32)) < F.col("share") * (1 << 32))
        once = near.groupBy("lang", "h").agg(F.min("slice").alias("slice"))
        before = F.sum(F.length("slice")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
        rows = once.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE).collect()
        for lang in {r["lang"] for r in rows}:
            texts = [r["slice"] for r in sorted(rows, key=lambda r: r["h"]) if r["lang"] == lang]
            if sum(map(len, texts)) >= SAMPLE or shares[lang] >= 1:
                out[lang] = read(" ".join(texts)[:SAMPLE])
        shares = {lang: min(1.0, 16 * share) for lang, share in shares.items() if lang not in out and share < 1}
    return out


#: A language's name, sample size, symbols by byte (0: not in the sample), and automaton: states, and edges of state, symbol and next state.
Model = tuple[str, int, np.ndarray, int, np.ndarray]


def train(texts: dict[str, bytes]) -> list[Model]:
    """A model of each language, in order."""
    out: list[Model] = []
    for lang in sorted(texts):
        symbol = np.zeros(256, np.uint8)
        seen = sorted(set(texts[lang]))
        symbol[seen] = np.arange(1, len(seen) + 1)
        edges = suffix_automaton(symbol[np.frombuffer(texts[lang], np.uint8)].tolist())
        out.append((lang, len(texts[lang]), symbol, len(edges), np.array([(state, c, to) for state, row in enumerate(edges) for c, to in row.items()], np.int32)))
    return out


def tables(models: list[Model]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the widest alphabet, flat tables of all models' parsers, and their first states."""
    width, base = 1 + max(int(m[2].max()) for m in models), 0
    following, begins, first = [], [], []
    for _, _, _, states, edges in models:
        rows: list[dict[int, int]] = [{} for _ in range(states)]
        for state, c, to in edges.tolist():
            rows[state][c] = to
        f, b = parser_table(rows, width)
        following.append((f + base).ravel())
        begins.append(b.ravel())
        first.append(base)
        base += states
    return width, np.concatenate(following), np.concatenate(begins).astype(np.int32), np.array(first, np.int32)


def _parse(shared):
    """The best language and the bits that the best two need, over these models and those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        width, following, begins, first = tables(models)
        codes = np.stack([m[2] for m in models])
        price = np.array([log2(m[1] + 1) + 8 for m in models])
        names = [m[0] for m in models]
        for batch in common.slices(batches, "text", SLICE):
            raw = [read(t or "") for t in batch.column("text").to_pylist()]
            lengths = np.array([len(r) for r in raw], np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            phrases = lockstep.run_texts(lengths, SEGMENT, codes[:, data], following, begins, width, first)
            bits = phrases * price[:, None]
            bits[:, [not r.strip() for r in raw]] = np.inf
            best = batch.column("best").to_numpy(zero_copy_only=False).copy()
            second = batch.column("second").to_numpy(zero_copy_only=False).copy()
            found = batch.column("found").to_pylist()
            for name, now in zip(names, bits, strict=True):
                better = now < best
                second = np.minimum(second, np.where(better, best, now))
                best = np.where(better, now, best)
                for k in np.flatnonzero(better):
                    found[k] = name
            rest = [c for c in batch.schema.names if c not in ("best", "second", "found")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(best), pa.array(second), pa.array(found, pa.string())], names=[*rest, "best", "second", "found"])

    return run


def cross_parsing(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; nothing is learned from documents that are held out."""
    docs = common.id_and_text(docs, "lang").withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    models = train(sample(docs.withColumn("lang", F.col("lang").cast("string"))))
    least = F.lit(float("inf"))
    parsed = docs.select("doc_id", "held_out", "text", least.alias("best"), least.alias("second"), F.lit(None).cast("string").alias("found"))
    for k in range(0, len(models), AT_ONCE):
        shared = docs.sparkSession.sparkContext.broadcast(models[k : k + AT_ONCE])
        parsed = parsed.mapInArrow(_parse(shared), "doc_id long, held_out boolean, text string, best double, second double, found string")
    below = F.when(F.col("found").isNull(), 0.0).when(F.col("second") == float("inf"), 1.0).otherwise(1 - F.col("best") / F.col("second"))
    return parsed.select("doc_id", "held_out", F.coalesce("found", F.lit(UNKNOWN)).alias("lang_pred"), below.alias("score"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing(common.documents(spark, sf_dir))
