"""Quality rules by the divergence of a document's histograms from its language's.

Every language has two references, gathered over all documents that bear it: the share of each character class, and the
share of each of its TOP commonest words and of all other words. A document's own shares are compared with them by the
Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). A document is rejected if either distance exceeds its
threshold. Short histograms are far from any reference by chance, so each distance counts only from a length on: the words'
from MIN_WORDS words, the characters' from MIN_CHARS characters.

Documents without a language are compared with the reference of all documents. References of the commonest languages are
broadcast, those of all others are joined to their documents.

Cases: a null or empty text has no words, so it fails the base rule; a null doc_id is kept as null; repeated rows are judged
alike; an empty table gives an empty result; further columns may bear any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.llm import common

#: Least words and characters for a verdict, common words per language, greatest distances of characters and of words.
MIN_WORDS, MIN_CHARS, TOP, CHAR_LIMIT, WORD_LIMIT = 100, 200, 100, 0.31, 0.53
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Languages whose references (some 3 kB each) are broadcast; those of the others are joined.
BROADCAST = 1024

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "letter_beyond", "continued")
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other_ascii"), np.uint8)
    for name, of in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [32, *range(9, 14)]), ("stop", b".,;:!?'\"()-"), ("symbol", SYMBOLS), ("letter_beyond", range(0xC0, 256)), ("continued", range(0x80, 0xC0))):
        table[list(of)] = CLASSES.index(name)
    return table


CLASS_OF = _class_table()
#: Continuation bytes aren't characters of their own.
N_CLASSES = len(CLASSES) - 1


def byte_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def class_histogram(by_byte: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_OF, weights=by_byte, minlength=len(CLASSES))[:N_CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Root of the Jensen-Shannon divergence in bits; 1 if either has no mass."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return float(np.sqrt(max(0.0, min(1.0, (kl(p) + kl(q)) / 2))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, what ('c' for a class, 'w' for a word), key and count of a task's documents."""
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            n = len(counter)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(["w"] * n, pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["lang", "what", "key", "n"])
        words.clear()

    for batch in common.slices(batches, "text", common.SLICE):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                words.setdefault(lang, Counter()).update(text.lower().split())
                classes[lang] = classes.get(lang, 0) + class_histogram(byte_histogram(text))
        if sum(map(len, words.values())) > HELD:
            yield from flush()
    yield from flush()
    for lang, hist in classes.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * N_CLASSES, pa.string()), pa.array(["c"] * N_CLASSES, pa.string()), pa.array([c.encode() for c in CLASSES[:N_CLASSES]], pa.binary()), pa.array(hist.astype(np.int64))], names=["lang", "what", "key", "n"])


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def _reference(rows: list[dict], total: int) -> Reference:
    """Class counts, the common words' places, and counts of these words and of all others."""
    by_class = {r["key"].decode(): r["n"] for r in rows if r["what"] == "c"}
    words = {r["key"]: r["n"] for r in rows if r["what"] == "w"}
    return np.array([by_class.get(c, 0) for c in CLASSES[:N_CLASSES]], float), {w: i for i, w in enumerate(words)}, np.array([*words.values(), total - sum(words.values())], float)


def references(docs: DataFrame) -> tuple[dict[str | None, Reference], DataFrame | None]:
    """The references of the BROADCAST commonest languages and, at None, of all documents; a table of the others: lang, ref.

    A fixed number of rows reach the driver: BROADCAST times TOP words and classes.
    """
    counts = docs.select("lang", "text").mapInArrow(_counts, "lang string, what string, key binary, n long")
    counts = common.materialize(counts.groupBy("lang", "what", "key").agg(F.sum("n").alias("n")), "language-counts")
    totals = counts.where("what = 'w'").groupBy("lang").agg(F.sum("n").alias("total"))
    first = {r["lang"]: r["total"] for r in totals.where("lang is not null").orderBy(F.desc("total"), "lang").limit(BROADCAST + 1).collect()}
    largest = counts.sparkSession.createDataFrame([(x,) for x in list(first)[:BROADCAST]], "lang string")
    every = counts.groupBy("what", "key").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "what", "key", "n")
    rank = Window.partitionBy("lang", "what").orderBy(F.desc("n"), "key")
    top = lambda df: df.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= TOP)
    first[None] = totals.agg(F.sum("total")).first()[0] or 0
    rows: dict[str | None, list[dict]] = {}
    for r in top(counts.join(F.broadcast(largest), "lang").select("lang", "what", "key", "n").unionByName(every)).orderBy("r").collect():
        rows.setdefault(r["lang"], []).append({"what": r["what"], "key": bytes(r["key"]), "n": r["n"]})
    shared = {lang: _reference(mine, first[lang]) for lang, mine in rows.items()}
    if len(first) - 1 <= BROADCAST:
        return shared, None
    others = top(counts.where("lang is not null").join(F.broadcast(largest), "lang", "left_anti")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "what", "key", "n"))).alias("rows"))
    return shared, common.materialize(others.join(totals, "lang").select("lang", F.struct("rows", "total").alias("ref")), "rare-languages")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(words) < 4:
        return 0
    places: dict[bytes, int] = {}
    at = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
    # A pair's number and the third word fit 64 bits, as a text has less than 2 ** 31 words.
    _, pair = np.unique(at[:-1] * len(places) + at[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(places) + at[2:], return_inverse=True, return_counts=True)
    many = np.flatnonzero(times[window] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[many + shift] = True
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _measures(lang: str | None, raw: bytes, refs: dict[str | None, Reference], own_ref: dict | None, limits: tuple) -> tuple:
    char_limit, word_limit, min_words, min_chars = limits
    by_byte = byte_histogram(raw)
    words = raw.split()
    n = len(words)
    chars = int(by_byte.sum() - by_byte[0x80:0xC0].sum() - by_byte[[32, *range(9, 14)]].sum())
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    by_class, places, shares = (_reference(own_ref["rows"], own_ref["total"]) if own_ref else refs.get(lang) or refs.get(None)) or (np.zeros(N_CLASSES), {}, np.zeros(1))
    own = np.zeros(len(shares))
    for word, k in Counter(raw.lower().split()).items():
        own[places.get(word, -1)] += k
    far = js_distance(class_histogram(by_byte), by_class), js_distance(own, shares)
    kept = not failed and (chars < min_chars or far[0] <= char_limit) and (n < min_words or far[1] <= word_limit)
    return n, chars, int(by_byte[list(SYMBOLS)].sum()), duplicate_lines(raw), repeats, failed, kept, *(floor(x * 1e6 + 0.50037) / 1e6 for x in far)


def _judge(refs, limits: tuple, only_kept: list[str] | None = None):
    """Measures after the columns other than lang, text and ref; with only_kept those columns of the documents that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", common.SLICE):
            langs, texts = batch.column("lang").cast(pa.string()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            own = batch.column(REF).to_pylist() if REF in batch.schema.names else [None] * len(langs)
            found = [_measures(lang, text or b"", refs.value, ref, limits) for lang, text, ref in zip(langs, texts, own, strict=True)]
            if only_kept is not None:
                yield batch.select(only_kept).filter(pa.array([f[6] for f in found], pa.bool_()))
                continue
            columns = list(zip(*found, strict=True)) or [[]] * 9
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64())
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
            rest = [c for c in batch.schema.names if c not in ("lang", "text", REF)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*rest, *names])

    return run


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
#: The column of references that are joined.
REF = "reference of a rare language"


def _with_references(docs: DataFrame, plain: DataFrame):
    """docs with the references of rare languages, and all others as a broadcast."""
    shared, others = references(plain)
    if others is not None:
        named = others.select(F.col("lang").alias(f"{REF}'s name"), F.col("ref").alias(REF))
        docs = docs.join(named, docs["lang"].cast("string") == named[f"{REF}'s name"], "left").drop(f"{REF}'s name")
    return docs, docs.sparkSession.sparkContext.broadcast(shared)


def divergence_rules(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id with the base measures, base_failed, kept and both distances, to six digits."""
    docs = common.id_and_text(docs, "lang")
    docs, refs = _with_references(docs, docs)
    return docs.mapInArrow(_judge(refs, (char_limit, word_limit, min_words, min_chars)), f"doc_id long, {_MEASURES}")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    joined, refs = _with_references(docs, common.id_and_text(docs, "lang"))
    return joined.mapInArrow(_judge(refs, (CHAR_LIMIT, WORD_LIMIT, MIN_WORDS, MIN_CHARS), docs.columns), docs.schema)


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(common.documents(spark, sf_dir))


_WORD = r"[^\x20\x09-\x0D]+"
_OF = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": """[.,;:!?''"()-]""", "symbol": "[#*$%&|<>]", "letter_beyond": r"[^\x00-\x7F]"}
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{_WORD}') AS ws FROM t),
x AS (SELECT doc_id, lang, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {", ".join(f"length(regexp_replace(t, '{p.replace('[^', '[') if p.startswith('[^') else '[^' + p[1:]}', '', 'g')) AS c_{c}" for c, p in _OF.items())}, length(t) AS n,
  list_filter(string_split(t, chr(10)), lambda z: regexp_matches(z, '{_WORD}')) AS ls, list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) AS g FROM w),
seen AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS g FROM x),
many AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM seen) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM many GROUP BY doc_id),
cl AS (SELECT doc_id, lang, unnest({list(CLASSES[:N_CLASSES])}) AS c, unnest([c_lower, c_upper, c_digit, c_space, c_stop, c_symbol, n - c_lower - c_upper - c_digit - c_space - c_stop - c_symbol - c_letter_beyond, c_letter_beyond])::DOUBLE AS k FROM x),
rc AS (SELECT lang, c, sum(k) AS k FROM cl WHERE lang IS NOT NULL GROUP BY lang, c UNION ALL SELECT NULL, c, sum(k) FROM cl GROUP BY c),
dw AS (SELECT doc_id, lang, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*)::DOUBLE AS k FROM (SELECT doc_id, lang, unnest(ws) AS w FROM x) GROUP BY ALL),
lw AS (SELECT lang, w, sum(k) AS k FROM dw WHERE lang IS NOT NULL GROUP BY lang, w UNION ALL SELECT NULL, w, sum(k) FROM dw GROUP BY w),
tw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, w) AS r, sum(k) OVER (PARTITION BY lang) AS total FROM lw) WHERE r <= {TOP}),
rw AS (SELECT lang, w, k FROM tw UNION ALL SELECT lang, '', any_value(total) - sum(k) FROM tw GROUP BY lang),
dk AS (SELECT doc_id, x.lang, rw.w, rw.k AS q, coalesce(dw.k, 0) AS p, n_words FROM x JOIN rw ON x.lang IS NOT DISTINCT FROM rw.lang LEFT JOIN dw USING (doc_id, w)),
pw AS (SELECT doc_id, CASE WHEN w = '' THEN n_words - sum(p) OVER (PARTITION BY doc_id) ELSE p END AS p, q FROM dk),
pc AS (SELECT cl.doc_id, cl.k AS p, rc.k AS q FROM cl JOIN rc ON cl.c = rc.c AND cl.lang IS NOT DISTINCT FROM rc.lang),
js AS (SELECT kind, doc_id, CASE WHEN sp = 0 OR sq = 0 THEN 1 ELSE sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p / sp * log2(2 * p / sp / (p / sp + q / sq)) ELSE 0 END + CASE WHEN q > 0 THEN q / sq * log2(2 * q / sq / (p / sp + q / sq)) ELSE 0 END) / 2))) END AS d
  FROM (SELECT *, sum(p) OVER (PARTITION BY kind, doc_id) AS sp, sum(q) OVER (PARTITION BY kind, doc_id) AS sq FROM (SELECT 'c' AS kind, * FROM pc UNION ALL SELECT 'w', * FROM pw)) GROUP BY kind, doc_id, sp, sq),
v AS (SELECT x.doc_id, n_words, word_chars, c_symbol, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, a.d AS dc, b.d AS dw FROM x LEFT JOIN rep USING (doc_id) JOIN js a ON a.kind = 'c' AND a.doc_id = x.doc_id JOIN js b ON b.kind = 'w' AND b.doc_id = x.doc_id)
SELECT doc_id, n_words, word_chars, c_symbol AS n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (word_chars < {MIN_CHARS} OR dc <= {CHAR_LIMIT}) AND (n_words < {MIN_WORDS} OR dw <= {WORD_LIMIT}) AS kept, floor(dc * 1e6 + 0.50037::DOUBLE) / 1e6 AS char_distance, floor(dw * 1e6 + 0.50037::DOUBLE) / 1e6 AS word_distance FROM v
"""
