"""Pieces of texts as numbers, and the search that looks them up."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_indexes import found

from vapora.functions import catalogue, pieces
from vapora.operators import search


def keys_of(text):
    raw = text.encode()
    whole = {pieces.whole_key(raw)} if 0 < len(raw) <= 4 else set()
    return {pieces.key(raw[k : k + s]) for s in range(1, 9) for k in range(len(raw) - s + 1)} | whole


def test_all_and_wanted_pieces_of_texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab é€😀") for _ in range(draw.randrange(12)))
    lists = [[word() if draw.random() < 0.9 else None for _ in range(draw.randrange(4))] for _ in range(200)] + [None, [], [""], [None]]
    want = [set().union(*(keys_of(t) for t in x or [] if t)) for x in lists]
    asked = sorted({k for x in want for k in x})[::7] + [pieces.key(b"zz")]
    batch = pa.RecordBatch.from_pydict({"sought": pa.array(lists, pa.list_(pa.string())), "at": list(range(len(lists)))})
    for wanted in (None, np.array(asked), np.array([], np.int64)):
        # a part of a batch, too
        for some, lo in ((batch, 0), (batch.slice(17, 60), 17)):
            (out,) = pieces.met(["at"], lambda: wanted)(iter([some]))  # noqa: B023
            got = out.column("met").to_pylist()
            assert all(len(x) == len(set(x)) for x in got) and out.column("at").to_pylist() == some.column("at").to_pylist()
            assert [set(x) for x in got] == [x if wanted is None else x & set(wanted.tolist()) for x in want[lo : lo + len(got)]]
    (pairs,) = pieces.pairs(iter([batch]))
    told = dict(zip(pairs.column("pair").to_pylist(), pairs.column("n").to_pylist()))
    raws = [t.encode() for x in lists for t in x or [] if t]
    assert told[ord("a") * 256 + ord("b")] == sum(r.count(b"ab") for r in raws) and told[65_536 + ord("a")] == sum(r.count(b"a") for r in raws)
    assert (next(pieces.pairs(iter([])))).num_rows == 0


def rings(spark, n, first=10_000):
    cells = {"ord": F.col("id").cast("int"), "id": F.concat(F.lit("u"), "id"), "name": F.concat(F.element_at(F.array(*map(F.lit, ("large", "cold", "blue", "old", "new", "green"))), (F.col("id") % 6 + 1).cast("int")), F.lit(" ring "), F.col("id") + first), "synonyms": F.array(F.lit("standard")), "provisional": F.lit(True)}
    mine = spark.range(n).select(*(cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in catalogue.compounds(spark).schema.fields))
    return search.dictionary(spark, mine)


def test_a_query_meets_the_entries_of_the_word_that_fewest_have(spark):
    """Pairs of letters make 'large' seem rarer than three digits; counted, a sixth of the entries has it and few have those digits."""
    entries = rings(spark, 9000)
    numbers = [k * 7 + 100 for k in range(60)]
    met = search._candidates(search._asked(spark.createDataFrame([(f"ring  Large {k}",) for k in numbers], "q string")), search.index(entries)).where("src = 1")  # codes of the fixed entries hold digits, too
    got = {r.q: r["count"] for r in met.groupBy("q").count().collect()}
    assert got == {f"ring  Large {k}": n for k in numbers if (n := sum(str(k) in str(i) for i in range(10_000, 19_000)))}


@pytest.mark.parametrize("limits", [{"SENT": 3}, {"HOT": 1, "MOST": 3}, {"HOT": 1}, {"SENT": 3, "HOT": 1, "MOST": 5}])
def test_however_queries_and_entries_meet(spark, monkeypatch, limits):
    entries = rings(spark, 60).cache()
    queries = ["x", "é", "1 0", "e t h", "10 large", "large ring 10007", "7", "64-17-5", "cco", "acid", "standard", "RING", "zz top", "al", "ring 10 zz", "gas leak"]
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    want = found(search.search(asked, entries))
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    assert found(search.search(asked, entries, keys=search.index(entries))) == want


def test_entries_are_not_broadcast(spark):
    entries = rings(spark, 2000)
    asked = spark.createDataFrame([(f"large ring {k}",) for k in range(10_000, 10_050)], "q string")
    plan = search.search(asked, entries, keys=search.index(entries))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
