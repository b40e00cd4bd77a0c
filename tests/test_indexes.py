"""Search by index against the scan, close matches against every pair, manifests by paths, values in words."""

import random

from pyspark.sql import functions as F

from vapora.functions import catalogue
from vapora.operators import feasibility, search
from vapora.plans import manifest


def found(df):
    return sorted((r.q, r["rank"], r.kind, r.id, r.score) for r in df.collect())


def test_index_finds_what_the_scan_finds(spark):
    entries = search.dictionary(spark).cache()
    names = [r.name for r in entries.select("name").collect()]
    queries = ["", " ", "x", "e", "a b", "c o", "64-17-5", "cco", "CC(=O)C", "oil  mint", "acid acetic", "e t h", "ethyl", "é", "zz top", "ring zz", "gas leak", "al", "-", "(", "ol al", *names, *(n[1:5] for n in names), *(" ".join(reversed(n.split())) for n in names), *(n.upper() for n in names[:9])]
    asked = spark.createDataFrame([(q,) for q in queries] + [(None,)], "q string")
    assert found(search.search(asked, entries, keys=search.index(entries))) == found(search.search(asked, entries))
    assert found(search.exact_resolve(asked, entries, search.index(entries))) == found(search.exact_resolve(asked, entries))
    assert search.search(asked.where("false"), entries, keys=search.index(entries)).count() == 0
    assert search.search(asked, entries.where("false"), keys=search.index(entries.where("false"))).count() == 0


def test_index_of_a_hundred_thousand_entries(spark):
    schema = catalogue.compounds(spark).schema
    draw = "concat_ws(' ', conv(pmod(hash(id), 46656), 10, 36), conv(pmod(hash(id, 1), 46656), 10, 36))"
    cells = {"ord": F.col("id").cast("int"), "id": F.concat(F.lit("u"), "id"), "name": F.expr(draw), "synonyms": F.array().cast("array<string>"), "provisional": F.lit(True)}
    mine = spark.range(100_000).select(*(cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
    entries = search.dictionary(spark, mine)
    wanted = [r.name for r in mine.where("ord % 2500 = 7").select("name").collect()]
    asked = spark.createDataFrame([(w,) for w in wanted], "q string")
    met = search._candidates(search._asked(asked), search.index(entries))
    assert met.count() < 40 * 1500  # of four million pairs
    best = {r.q: r.score for r in search.search(asked, entries, 1, search.index(entries)).collect()}
    assert best == dict.fromkeys(wanted, 95)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_close_matches_equal_every_pair(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randrange(7)))
    words, names = {word() for _ in range(150)}, {word() for _ in range(150)}
    a, b = (spark.createDataFrame([(w,) for w in [*some, *list(some)[:5], None]], f"{c} string") for some, c in ((words, "w"), (names, "n")))
    for edits in (0, 1, 2):
        got = {(r.w, r.n): r.distance for r in search.close_matches(a, "w", b, "n", edits).collect()}
        assert got == {(w, n): d for w in words for n in names if (d := distance(w, n)) <= edits}


def test_manifest_paths_and_shapes(spark):
    texts = ['{"sensor": {"channels": [{"id": "a"}, {"id": "b"}]}, "lab": {"k": [1, 2.5]}}', '{"lab": {"k": "x"}}', "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "manifest string")
    m = F.col("manifest")
    got = df.select(manifest.at(m, "sensor.channels[1].id").alias("b"), manifest.at(m, "lab.k[1]", "double").alias("k"), manifest.at(m, "lab.k", "int").alias("wrong")).collect()
    assert [tuple(r) for r in got] == [("b", 2.5, None), (None, None, None), (None, None, None), (None, None, None)]
    assert "channels: ARRAY<" in manifest.shape(df).first().shape
    assert spark.range(1).select(manifest.same(F.lit('{"a": 1, "b": [2]}'), F.lit('{"b":[2],"a":1}'))).first()[0]


def test_manifests_that_differ_in_the_form_of_numbers_say_the_same(spark):
    same = [('{"a": 9.6E-4}', '{"a":0.00096}'), ('{"a": [1, 2.0]}', '{"a":[1.0,2e0]}'), (r'{"a": "1.0\" x", "b": {}}', r'{"b": {}, "a": "1.0\" x"}'), ("[" + '"\\\\",' * 20_000 + "1.50]", "[" + '"\\\\",' * 20_000 + "1.5]")]
    other = [('{"a": "1.0"}', '{"a": "1"}'), ('{"a": 1}', '{"a": "1"}'), ('{"a": 0.00096}', '{"a": 0.00097}'), ('{"a": 12345678901234567}', '{"a": 12345678901234568}'), ('{"a": 1, "b": 2}', '{"a": 2, "b": 1}'), ('{"a": true}', '{"a": 1}')]
    df = spark.createDataFrame(same + other, "a string, b string")
    assert [r[0] for r in df.select(manifest.same(F.col("a"), F.col("b"))).collect()] == [True] * len(same) + [False] * len(other)


def test_values_in_words(spark):
    rows = [(None, "unknown", "unknown"), (0.4, "0 Pa", "0.4"), (99.94, "100 Pa", "99.9"), (150.0, "150 Pa", "150"), (2345.0, "2.35 kPa", "2345"), (101325.0, "101 kPa", "101k")]
    df = spark.createDataFrame([(x,) for x, _, _ in rows], "x double")
    got = df.select(feasibility.told_pa(F.col("x")).alias("a"), feasibility.told_ppm(F.col("x")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in rows]
    ratios = spark.createDataFrame([(x,) for x in (12.34, 1.234, 0.5, 0.01234)], "x double").select(feasibility.told_ratio(F.col("x"))).collect()
    assert [r[0] for r in ratios] == ["12.3× ethanol", "1.23× ethanol", "50% of ethanol", "1.2% of ethanol"]


def test_entries_met_do_not_grow_with_the_dictionary(spark):
    """Names that differ by a number, each asked for: a query meets the entries that hold its number, not those that share two digits."""
    schema = catalogue.compounds(spark).schema
    cells = {"ord": F.col("id").cast("int"), "id": F.concat(F.lit("u"), "id"), "name": F.concat(F.lit("large ring "), F.col("id") + 10_000), "synonyms": F.array().cast("array<string>"), "provisional": F.lit(True)}
    met = {}
    for n in (2000, 20_000):
        mine = spark.range(n).select(*(cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
        entries = search.dictionary(spark, mine)
        asked = mine.where("ord < 500").select(F.col("name").alias("q"))
        met[n] = search._candidates(search._asked(asked), search.index(entries)).count()
        best = search.search(asked, entries, 1, search.index(entries)).collect()
        assert len(best) == 500 and {r.score for r in best} == {95}
    assert met[20_000] < 2 * met[2000] < 4000
