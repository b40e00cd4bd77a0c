import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from vapora.llm import common, divergence_rules, exact_dedup, heavy_light_join, pii_spans, tokens


def test_stages_take_effect(spark, sf):
    docs = common.documents(spark, sf)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and [d[1] for d in out.dtypes] == [d[1] for d in docs.dtypes]
        seen.append((docs, out))
        docs = out
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(seen[0][1]) == ids(divergence_rules.divergence_rules(seen[0][0]).where("kept"))
    assert ids(seen[1][1]) == ids(exact_dedup.exact_dedup(seen[1][0]).where("kept"))
    assert ids(seen[2][1]) == ids(heavy_light_join.ngram_components(seen[2][0]).where("doc_id = component_id"))
    assert ids(seen[3][1]) == ids(seen[3][0]) and seen[3][1].where(F.col("text").contains("@")).count() <= seen[3][0].where(F.col("text").contains("@")).count()
    assert seen[3][1].where("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids(pieces) == ids(docs)


def test_whole_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "personal_data", "packing"]


def test_empty_table(spark, sf):
    docs = common.documents(spark, sf).where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
        assert docs.count() == 0


CLASHING = ["kept", "keep_id", "group_size", "text_sha256", "_t", "_spans", "_m_email", "row", "sha", "norm", "digest", "seen", "salt", "n", "spans", "label", "class", "component_id", "filter_row", "h", "t", "mark", "total", "ref", "what"]


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", *(f"w{k}" for k in range(400))], n))


def awkward(spark):
    """Documents with nulls, ties, repeated rows, near copies and a long text, and a column of every working name."""
    long = words(1, 60_000)
    near = words(2, 300)
    rows = [
        (1, None), (2, ""), (3, "  \n "), (4, words(3, 100)), (5, words(3, 100)), (5, words(3, 100)), (6, words(3, 100).replace(" ", "\t ")), (None, words(3, 100)), (None, words(4, 100)), (7, long), (8, near), (9, near + " end"), (10, near + " other end"),
        (11, words(5, 80) + " mail a.b@c.de or call +49 170 1234567 " + words(6, 80)), (11, words(7, 90)), (12, "é" * 300), (13, words(8, 200)), (-1, words(8, 200)),
    ]
    return common.materialize(spark.createDataFrame([(i, t, "en" if k % 4 else None, "s", len(t or ""), *("x" for _ in CLASHING)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)), "awkward")


def test_stages_on_awkward_tables(spark, sf):
    docs = awkward(spark)
    everything = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        alone = stage(spark, docs, sf)
        assert alone.schema.simpleString() == docs.schema.simpleString()
        got = alone.collect()
        assert all(r[c] == "x" for r in got for c in CLASHING)
        pairs = [(r.doc_id, r.text) for r in got]
        ids = [i for i, _ in pairs]
        if name == "quality_rules":
            assert {1, 2, 3, 12}.isdisjoint(ids) and {7, 8, 4, 13} <= set(ids) and set(pairs) <= everything
        if name == "exact_dedup":
            assert set(pairs) <= everything and {2, 5, 6, 13}.isdisjoint(ids) and ids.count(None) == 1 and {1, 3, 4, 7, -1} <= set(ids)
        if name == "near_dedup":
            assert set(ids) & {8, 9, 10} == {8} and set(ids) & {13, -1} == {-1} and ids.count(None) == 2 and {1, 2, 3, 7} <= set(ids)
        if name == "personal_data":
            masked = dict(p for p in pairs if p[1] and "mail" in p[1])
            assert len(pairs) == docs.count() and "<EMAIL>" in masked[11] and "<PHONE>" in masked[11] and (1, None) in pairs
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == {i for i, _ in everything}


def plain_pipeline(docs, lang, shares):
    """Ids and masked texts after the first four stages, with operators' verdicts of the first stage given."""
    kept = {i: t for i, t in docs.items() if shares[i]}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.encode().lower().split()) for i, t in kept.items())}
    up = {i: i for i in kept}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in combinations(sorted(kept), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i for i in kept if find(i) == i}


def test_run_against_a_plain_version(spark, sf):
    docs = common.documents(spark, sf)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    verdicts = {r.doc_id: r.kept for r in divergence_rules.divergence_rules(docs).collect()}
    want = plain_pipeline(texts, None, verdicts)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want
    masked = {r.doc_id: r.text for r in pii_spans.mask_pii(docs.where(F.col("doc_id").isin(sorted(want)))).collect()}
    for i in want:
        assert sum(r.length for r in got if r.doc_id == i) == len(tokens.encode(masked[i])) + 1
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
