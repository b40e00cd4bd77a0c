"""The corpus queries against their SQL, against plain versions, and on awkward tables."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import same  # noqa: E402

from vapora.llm import bpe_words, common, cross_parsing, divergence_rules, exact_dedup, heavy_light_join, hilbert_shards, pii_spans, registry, squares_packing, suffix_dedup, suffix_tree_lm, tokens  # noqa: E402

SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, digest string, bucket int, block long, salt int, size long, class string, label string, n int, spans string"


def table(spark, rows):
    """documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "w", "d", 1, 2, 3, 4, "c", "l", 5, "x") for i, t, lang in rows], SCHEMA)


ODD = [
    (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "word", "en"), (5, "word", "en"), (5, "word", "en"), (None, "word", None), (6, "a b c d e f g h " * 40, "en"), (7, "a  b c d e f g h " * 40, "de"),
    (8, "x" * 70_000, "en"), (9, "1 " * 3000, None), (10, "été größer ñandú 😀 中文 " * 30, "fr"), (11, "mail a.b@c.de, +49 170 1234567 and 4111 1111 1111 1111 from 10.0.0.255", "en"), (-3, "<|endoftext|> it's 12  \r\n", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return common.materialize(table(spark, ODD), "odd")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), sf, registry.ORACLE_SQL[name])


OPERATORS = {
    1: divergence_rules.divergence_rules, 3: heavy_light_join.ngram_components, 5: bpe_words.bpe_words, 6: cross_parsing.cross_parsing, 8: suffix_tree_lm.suffix_tree_scores, 9: exact_dedup.exact_dedup, 10: suffix_dedup.suffix_dedup,
    2: lambda d: hilbert_shards.hilbert_shards(d.select("doc_id", "lang", F.length("text").alias("size")), [hilbert_shards.quantise_number(F.col("size")), hilbert_shards.quantise_name(F.col("lang"))], 3), 4: pii_spans.find_pii,
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_awkward_and_empty_tables(spark, odd, n):
    assert OPERATORS[n](odd).count() == len(ODD)
    assert OPERATORS[n](odd.where("false")).count() == 0


def test_packing_of_awkward_and_empty_tables(odd):
    assert squares_packing.squares_packing(odd.where("false")).count() == 0
    assert squares_packing.squares_packing(odd).select(F.count_distinct(F.struct("doc_id", "ids_crc32"))).first()[0] > 5


# --- 1 ------------------------------------------------------------------------


def test_base_measures(spark, docs, texts, odd):
    for frame, of in ((docs, texts), (odd, None)):
        for r in divergence_rules.divergence_rules(frame).collect():
            if of is None and r.doc_id in (5, None):
                continue
            text = of[r.doc_id] if of else {i: t or "" for i, t, _ in ODD}[r.doc_id]
            words = [w for w in SPACE.split(text) if w]
            seen = Counter(zip(words, words[1:], words[2:]))
            covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if SPACE.sub("", x)]
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
            assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
            assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_verdict_divides_clean_from_junk(spark, sf, docs):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = divergence_rules.divergence_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    shares = {r.quality: r.kept for r in got}
    assert shares[1] == 1.0 and shares[0] < 0.2


def test_js_distance():
    assert divergence_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and divergence_rules.js_distance(np.array([1.0, 3]), np.array([2.0, 6])) == 0
    assert divergence_rules.js_distance(np.zeros(2), np.ones(2)) == 1


# --- 2 ------------------------------------------------------------------------


def test_curve_visits_neighbours(spark):
    n = 8
    grid = spark.range(n**3).selectExpr("cast(id % 8 AS int) AS x", "cast(id div 8 % 8 AS int) AS y", "cast(id div 64 AS int) AS z")
    rows = sorted((r.h, r.x, r.y, r.z) for r in grid.withColumn("h", hilbert_shards.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).collect())
    assert [r[0] for r in rows] == list(range(n**3))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def test_shards_are_even(spark, sf):
    got = hilbert_shards.op2_hilbert_shards(spark, sf).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_native_plan_has_no_python(spark, sf):
    for op in (hilbert_shards.op2_hilbert_shards, pii_spans.op4_pii_spans):
        plan = op(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 3 ------------------------------------------------------------------------


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n=60, words=30, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 1000, words)]
    out = {}
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, words, rng.integers(0, 3)):
            w[k] = f"z{rng.integers(0, 50)}"
        out[i] = " ".join(w)
    short = [f"q{k}" for k in range(14)]
    for i in range(n):
        w = list(short)
        for k in rng.integers(0, 14, rng.integers(0, 2)):
            w[k] = f"y{rng.integers(0, 3)}"
        out[1000 + i] = " ".join(w[: rng.integers(8, 15)])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, texts, seed, monkeypatch):
    corpus = near_copies(seed=seed) | ({k + 5000: v for k, v in texts.items()} if seed == 1 else {}) | {9001: "", 9002: " ", 9003: "one two", 9004: "One TWO"}
    got = heavy_light_join.ngram_components(table(spark, [(i, t, "en") for i, t in corpus.items()])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(corpus)


def test_sets_that_share_a_name(spark, texts):
    """With names of four bits nearly all classes clash, and are told apart."""
    corpus = near_copies(40, seed=4) | {k + 5000: v for k, v in list(texts.items())[:60]}
    got = heavy_light_join.ngram_components(table(spark, [(i, t, "en") for i, t in corpus.items()]), name_bits=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(corpus)


def test_boundary_follows_the_lists(docs):
    """The sketch of a real table: shingles that sets list are as frequent as its occurrences say, not as its empty counters."""
    empty, rare = np.zeros(1 << 16), np.zeros(1 << 16)
    rare[:400] = 8 * np.log2(2)
    common_ones = rare.copy()
    common_ones[400:410] = 8 * np.log2(1e4)
    assert heavy_light_join.usual_length(empty) == 1 and heavy_light_join.usual_length(rare) == 1 and heavy_light_join.usual_length(common_ones) > 1e3
    sizes = np.zeros(heavy_light_join.LIGHT_MOST + 1, np.int64)
    sizes[2:9] = 1000
    assert heavy_light_join.choose_boundary(sizes, heavy_light_join.usual_length(common_ones)) > heavy_light_join.choose_boundary(sizes, 1.0)


def test_many_documents_with_one_boilerplate(spark):
    """Documents of their own words round one passage: hardly any pair of them is tested."""
    passage = " ".join(f"b{k}" for k in range(40))
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.hex(F.xxhash64("id", k))), F.lit(passage)).alias("text"))
    rows = rows.withColumn("text", F.concat_ws(" ", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.hex(F.xxhash64("doc_id", k))), " "), F.lit(passage)))
    got = heavy_light_join.ngram_components(rows)
    assert got.where("component_id = doc_id").count() == 20_000


def test_light_sets_and_boundary():
    assert heavy_light_join.need(7, 7) == 6 and list(heavy_light_join.partners(4)) == [3, 4, 5]
    sizes = np.zeros(heavy_light_join.LIGHT_MOST + 1, np.int64)
    sizes[2:6] = 1000
    assert heavy_light_join.choose_boundary(sizes, 50.0) >= 5 and heavy_light_join.choose_boundary(np.zeros(heavy_light_join.LIGHT_MOST + 1, np.int64), 1.0) == 0


# --- 4 ------------------------------------------------------------------------


def plain_spans(text):
    out = []
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": "[0-9]([\x20-]?[0-9])+", "phone": "\\+[0-9][\x20().0-9-]+[0-9]"}
    for o, (kind, rule) in enumerate(rules.items()):
        for m in re.finditer(rule, text):
            d = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def test_spans_against_plain_search(spark, odd):
    rng = np.random.default_rng(0)
    alphabet = list("0123456789..@@ab-+ () é😀")
    rows = [(k, "".join(rng.choice(alphabet, rng.integers(0, 60))), "en") for k in range(400)] + [(1000, "4111 1111 1111 1111" * 50, "en"), (1001, "a" * 50_000 + "@b.c", "en"), (1002, "9" * 50_000, "en"), (1003, "1.2.3.4.5.6.7.8", "en"), (1004, "x@y.z@a.b_c@d.e", "en")]
    got = {r.doc_id: [(s.start, s.ord, s.end, s.kind) for s in r.spans if s.kind in pii_spans.BASE] for r in pii_spans.find_pii(table(spark, rows).drop("spans")).collect()}
    for k, text, _ in rows:
        assert got[k] == plain_spans(text), text[:80]


def test_other_kinds_and_masks(spark):
    rows = [(1, "iban DE89370400440532013000 end", "en"), (2, "DE89370400440532013001", "en"), (3, "social security 123-45-6789.", "en"), (4, "part 123-45-6789.", "en"), (5, "GB82 WEST 1234 5698 7654 32", "en"), (6, None, "en")]
    frame = table(spark, rows).drop("spans")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii_spans.find_pii(frame).collect()}
    assert "iban" in got[1] and "iban" not in got[2] and got[3] == ["ssn"] and got[4] == [] and "iban" in got[5] and got[6] == []
    masked = {r.doc_id: r.text for r in pii_spans.mask_pii(frame).collect()}
    assert masked[3] == "social security <SSN>." and masked[4] == rows[3][1] and masked[6] is None and "<IBAN>" in masked[1]


# --- 5, 7 -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return bpe_words._tokenizer(None)


def test_ids_and_decoding(docs, odd, texts, library):
    for frame in (docs, odd):
        for r in bpe_words.bpe_words(frame).collect():
            text = texts[r.doc_id] if frame is docs else dict((i, t) for i, t, _ in ODD)[r.doc_id] or ""
            ids = library.encode(text, add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_of_odd_white_space(library):
    rng = np.random.default_rng(3)
    alphabet = list("aB 1\n\t\r\x0b\x1c\x85\xa0\u200b\u2028\u3000é'sdl中½_-.😀")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert [x for w in bpe_words.split_words(text) for x in library.encode(w, add_special_tokens=False).ids] == ids == tokens.encode(text)


def plain_packing(lengths, capacity):
    """Longest first, into the sequence whose gap leaves the least sum of squared counts per gap; gaps and ties in ascending order."""
    gaps, places = [], []
    for x in sorted(lengths, reverse=True):
        tried = []
        for g in sorted({g for g in gaps if g >= x}):
            after = Counter(gaps)
            after[g] -= 1
            after[g - x] += 1
            tried.append((sum(n * n for gap, n in after.items() if gap), g))
        if tried:
            gaps[gaps.index(min(tried)[1])] -= x
        else:
            gaps.append(capacity - x)
        places.append(sorted(gaps))
    return sorted(gaps)


def test_packing_as_plain_sum_of_squares():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 200):
        lengths = rng.integers(1, 41, n)
        sequence, offset = squares_packing.sum_of_squares(lengths, 40)
        used = np.bincount(sequence, weights=lengths).astype(int)
        assert sorted(40 - used) == plain_packing(lengths.tolist(), 40)


def test_sequence_numbers_of_many_partitions(docs):
    got = squares_packing.squares_packing(docs.repartition(40), group=50).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and all(r.sequence_id < 0 for r in got if r.length == 2048)


def test_packing(docs, texts, library):
    got = squares_packing.squares_packing(docs, group=100).collect()
    by, places = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]])) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 2048 for r in pieces[1:]) and all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    for rows in places.values():
        rows.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in rows])
        assert [r.offset for r in rows] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= sum(r.length for r in got) / 2048 + 6


def test_sum_of_squares_is_near_the_bound():
    lengths = np.random.default_rng(2).integers(1, 1500, 5000)
    sequence, _ = squares_packing.sum_of_squares(lengths, 2048)
    assert len(set(sequence)) <= np.ceil(lengths.sum() / 2048) + 3


# --- 6 ------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = cross_parsing.op6_cross_parsing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_texts_without_letters_are_undetermined(odd):
    got = {r.doc_id: r.lang_pred for r in cross_parsing.cross_parsing(odd).collect()}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[10] != "und"


def test_automaton_parses_as_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sample, text = rng.integers(1, 4, 40).tolist(), rng.integers(0, 5, 50)
        following, begins = cross_parsing.parser_table(cross_parsing.suffix_automaton(sample), 5)
        phrases, k, joined = 0, 0, ",".join(map(str, sample))
        while k < len(text):
            n = 1
            while k + n <= len(text) and ",".join(map(str, text[k : k + n])) in joined:
                n += 1
            phrases, k = phrases + 1, k + max(1, n - 1)
        from vapora.llm import lockstep

        got = lockstep.run(text, np.array([0]), np.array([len(text)]), following.ravel(), begins.astype(np.int32).ravel(), 5, np.zeros(1, np.int32))
        assert got[0, 0] == phrases


def test_languages_as_plain_cross_parsing(spark, docs):
    """Every document's language and score by a search for each phrase, with a fifth language that labels few documents."""
    few = [(10_000 + k, f"zorp quux blarf {k} mip " * (k + 1), "xx") for k in range(9)] + [(20_000 + k, "東京都の図書館は静かです。" * k, "ja") for k in range(9)]
    corpus = docs.select("doc_id", "text", "lang").limit(60).unionByName(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    corpus = common.materialize(corpus, "languages")
    samples = cross_parsing.sample(corpus.withColumn("held_out", cross_parsing.held_out(F.col("doc_id"), 4, 2)))
    assert {"xx", "ja"} < set(samples)

    def phrases(text, of):
        k = n = 0
        while k < len(text):
            size = 1
            while k + size <= len(text) and text[k : k + size] in of:
                size += 1
            n, k = n + 1, k + max(1, size - 1)
        return n

    got = {r.doc_id: r for r in cross_parsing.cross_parsing(corpus).collect()}
    for r in corpus.collect():
        text = cross_parsing.read(r.text or "")
        if not text.strip():
            assert got[r.doc_id].lang_pred == "und"
            continue
        bits = sorted((phrases(text, of) * (np.log2(len(of) + 1) + 8), lang) for lang, of in samples.items())
        assert got[r.doc_id].lang_pred == bits[0][1] and got[r.doc_id].score == pytest.approx(1 - bits[0][0] / bits[1][0])
    assert got[20_005].lang_pred == "ja" and got[10_005].lang_pred == "xx"


def test_more_languages_than_one_pass(spark, docs, monkeypatch):
    want = sorted(cross_parsing.cross_parsing(docs).collect(), key=str)
    monkeypatch.setattr(cross_parsing, "AT_ONCE", 1)
    assert sorted(cross_parsing.cross_parsing(docs).collect(), key=str) == want


# --- 8 ------------------------------------------------------------------------


def test_base_scores_and_model(docs, texts):
    got = suffix_tree_lm.suffix_tree_scores(docs).collect()
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.encode().lower().split(), b" "])
    total, kinds = sum(c.values()), len(c)
    for r in got:
        words = [*texts[r.doc_id].encode().lower().split(), b" "]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in c for w in words), total)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in words))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tree_predicts_what_follows(spark):
    rows = [(k, "one two three four " * 20, "en") for k in range(30)] + [(k + 100, f"noise{k} " * 5, "en") for k in range(30)]
    got = suffix_tree_lm.suffix_tree_scores(table(spark, rows)).where("doc_id < 30").first()
    assert got.score > 0.2 * got.base_score  # nearly certain where the base isn't


def plain_tree_scores(rows, least, gain, depth):
    """Scores of (held, words) by plain counting of every context."""
    follow = [defaultdict(Counter) for _ in range(depth + 1)]
    for held, words in rows:
        for k, w in enumerate(words if not held else []):
            for d in range(min(k, depth) + 1):
                follow[d][tuple(words[k - d : k])][w] += 1
    root = follow[0][()]
    total, kept = sum(root.values()), set()
    for d in range(1, depth + 1):
        for u, c in follow[d].items():
            n, t, up = sum(c.values()), len(c), follow[d - 1][u[1:]]
            if n >= least:
                better = sum((m - 1) * np.log(m / up[w]) for w, m in c.items()) - (n - t) * np.log((n + t) / sum(up.values())) + t * np.log(t / (n + t))
                kept |= {u[k:] for k in range(d)} if better > gain else set()
    scores = []
    for _, words in rows:
        score = 0
        for k, w in enumerate(words):
            p = (root[w] + 1) / (total + len(root) + 1)
            for d in range(1, min(k, depth) + 1):
                if (u := tuple(words[k - d : k])) in kept:
                    c = follow[d][u]
                    p = (c[w] + len(c) * p) / (sum(c.values()) + len(c))
            score += np.log10(p)
        scores.append(score)
    return scores, Counter(map(len, kept))


@pytest.mark.parametrize("least, gain, depth", [(suffix_tree_lm.LEAST, suffix_tree_lm.GAIN, suffix_tree_lm.DEPTH), (2, 1.0, 4), (4, 12.0, 4), (3, 2.0, 2), (2, 1.0, 1)])
def test_scores_as_plain_counting(spark, docs, odd, least, gain, depth):
    for frame in (docs, odd):
        rows = frame.select("doc_id", "text").collect()
        plain = [(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2, [*(r.text or "").encode().lower().split(), b" "]) for r in rows]
        want, kept = plain_tree_scores(plain, least, gain, depth)
        got = suffix_tree_lm.suffix_tree_scores(frame.repartition(3), least=least, gain=gain, depth=depth).collect()
        order = lambda x: (x[0] is None, x[0] or 0, x[1])
        for (_, g), (_, w) in zip(sorted(((r.doc_id, r.score) for r in got), key=order), sorted(((r.doc_id, w) for r, w in zip(rows, want, strict=True)), key=order), strict=True):
            assert g == pytest.approx(w)
        assert frame is odd or kept[min(depth, 3)] > 0  # contexts of three words are in use


@pytest.mark.parametrize("least, gain", [(2, 0.5), (2, 5.0), (5, 3.0), (20, 5.0), (20, -1.0)])
def test_bounds_of_divergence(least, gain):
    """No distribution of next words exceeds the bound, and shorter contexts than least_parent have no suffix tree below them."""
    rng = np.random.default_rng(5)
    for _ in range(2000):
        m = rng.integers(1, 12, rng.integers(1, 8))
        above = m + rng.integers(0, 30, len(m)) * rng.integers(0, 2)
        n, t, up = int(m.sum()), len(m), int(above.sum() + rng.integers(0, 50))
        better = ((m - 1) * np.log(m / above)).sum() - (n - t) * np.log((n + t) / up) + t * np.log(t / (n + t))
        assert better <= suffix_tree_lm.most_gain(np.array([n]), np.array([up]))[0]
    may = lambda up: (suffix_tree_lm.most_gain(k := np.arange(least, up + 1), np.full(len(k), up)) > gain).any()
    first = next((up for up in range(least, 3000) if may(up)), 3000)
    parent = suffix_tree_lm.least_parent(least, gain)
    assert parent <= first and (gain <= 0 or first <= parent + 2)


def test_contexts_travel_by_numbers():
    """Blocks that share their contexts send a byte or two for each, not its digest, and what they say of it meets."""
    from vapora.llm import blocks

    lm, rule, buckets = suffix_tree_lm, (2, 2, 0.0), 32
    rng, words = np.random.default_rng(3), blocks.digests([b" ", *(b"w%d" % k for k in range(300))])
    texts = [np.r_[rng.integers(1, 301, 20000), 0] for _ in range(3)]
    total = sum(map(len, texts))
    docs = blocks.stream(pa.table({"doc_id": pa.array([1], pa.int64()), "held": [False], "n": pa.array([len(texts[0])], pa.int64())}))
    rows = [[(0, b, -1, words.tobytes(), blocks.pack(t), docs)] for b, t in enumerate(texts)]
    by_bucket = lambda some: [[r for r in some if r[2] == b] for b in range(buckets)]
    for step in range(2):
        asked = [lm._question(step, b, lm._opened(lm._table(mine), total, rule, step)[1], buckets) for b, mine in enumerate(rows)]
        for b, some in enumerate(by_bucket(sum(asked, []))):
            for r in lm._counted(2, (pa.scalar(b),), lm._table(some)).to_pylist() if some else []:
                if r["block"] >= 0:
                    rows[r["block"]].append(tuple(r.values())[:6])
    told = [lm._ask_contexts(total, rule, buckets)((), lm._table(mine)) for mine in rows]
    names = [lm._opened(lm._table(mine), total, rule, 2)[1].candidates()[1] for mine in rows]
    assert len(set.union(*map(set, names))) < 0.6 * sum(map(len, names))
    for table, mine in zip(told, names, strict=True):
        assert sum(len(lm._open(k)) for k in table.column("keys").to_pylist()) == len(mine)
        assert sum(map(len, table.column("keys").to_pylist())) < 2 * len(mine)


def test_without_training_documents(spark):
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = suffix_tree_lm.suffix_tree_scores(table(spark, [(held, "a b", "en")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


# --- 9 ------------------------------------------------------------------------


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_copies(odd, weak):
    digest = (lambda c: F.unhex(F.rpad(F.substring(F.md5(c), 1, 1), 64, "0"))) if weak else None  # a sixteenth of all texts collide
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()
    groups = plain_groups(ODD)
    by = {i: (min(x for x in g if x is not None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g if i is not None}
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in got if r.doc_id is not None} == {(i, *v, i == v[0]) for i, v in by.items()}
    nulls = [r for r in got if r.doc_id is None]
    assert [(r.keep_id, r.kept) for r in nulls] == [(4, False)]


def test_many_copies_and_carried_columns(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}", "en") for k in range(3000)]
    got = exact_dedup.exact_dedup(table(spark, rows), carry=("doc_id", "text", "digest")).where("kept").collect()
    assert len(got) == 1001 and {r.digest for r in got} == {"d"} and {r.keep_id for r in got} == {0, 1, *range(3, 3000, 3)}


# --- 10 -----------------------------------------------------------------------


def plain_removal(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        for k, w in enumerate(own):
            if first.get(w, i) < i:
                gone[k : k + 50] = True
        for w in own:
            first.setdefault(w, i)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 5, 200])
def test_repeated_passages(spark, texts, hot):
    rng = np.random.default_rng(7)
    passages = ["".join(rng.choice(list("abcd éß "), 70)) for _ in range(4)]
    rows = [(i, t) for i, t in texts.items()]
    rows += [(1000 + k, "".join(rng.choice(list("wxyz"), rng.integers(0, 90))) + passages[k % 4][: rng.integers(40, 71)] + "".join(rng.choice(list("mn"), rng.integers(0, 60)))) for k in range(120)]
    rows += [(2000, "a" * 300), (2001, "a" * 120), (2002, "ab" * 100), (2003, ""), (2004, "short")]
    got = suffix_dedup.suffix_dedup(table(spark, [(i, t, "en") for i, t in rows]), stable=False, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_removal(rows)


def test_texts_in_parts(spark):
    """Texts cut into parts give what whole ones do, with strings across the cuts and long texts that repeat others."""
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdé "), 2500))
    rows = [(1, long[100:900]), (2, long), (3, "x" + long[300:1800] + "".join(rng.choice(list("xyz"), 400)) + long[50:120]), (4, "short"), (5, long[:299]), (6, ""), (7, "ab" * 600)]
    got = suffix_dedup.suffix_dedup(table(spark, [(i, t, "en") for i, t in rows]), stable=False, hot=2, part=300).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_removal(rows)


def test_text_of_a_hundred_megabytes(spark):
    """No limit on a text's length: the whole of a long text is repeated, but for its start."""
    from pyspark.sql import functions as F

    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5_300_000)), lambda k: F.hex(F.xxhash64(k))), " ")).substr(F.lit(1), F.when(F.col("id") == 0, 40_000_000).otherwise(90_000_000)).alias("text"))
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(rows, stable=False).collect()}
    assert got[0].n_bytes == 40_000_000 and got[0].n_removed == 0 and got[1].n_bytes > 64 << 20 and got[1].n_removed == 40_000_000 and got[1].n_spans == 1


def test_suffix_arrays():
    from vapora.llm.lyndon_suffixes import suffix_arrays

    rng = np.random.default_rng(0)
    for _ in range(60):
        parts = [np.r_[rng.integers(1, rng.integers(2, 5), rng.integers(0, 60)), 0] for _ in range(rng.integers(1, 8))]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        text = np.concatenate(parts)
        want = [s + k for s, p in zip(starts, parts) for k in sorted(range(len(p)), key=lambda k: p[k:].tolist())]
        assert suffix_arrays(text, starts).tolist() == want
