"""Repair of conversations' structure by a forward Viterbi search over four grammar states.

A conversation is well formed if its roles' initials are `(s?(ua)+)?`. Its rows, by turn, are kept (0), given the role user or
assistant (1) or deleted (2); empty turns of user or assistant may be inserted anywhere (5); a truncated row that isn't
deleted adds 5; blank rows and duplicates have to be deleted. Of the cheapest repairs that one counts whose audit string, the
edits' initials in order, is least in ASCII.

The search carries the least (cost, audit) of each state (nothing yet, after s, after u, after a) from row to row; each row's
layer is closed by at most three insertions, since a fourth only comes back to a state at a higher cost. Equal costs can't
belong to strings of which one begins with the other (the longer one has more insertions, and letters fix the cost), so the
least string of a prefix stays least whatever follows.

No task holds a conversation's texts. A row is one letter to the search: rows get their places by one range partitioning, are
gathered in segments of SEGMENT letters, and each segment's answer to each of the four entry states is found apart; only
segments are folded in order, in one stream. Edits go back to rows by segment, so a conversation of any length is dealt over
many tasks. A conversation's audit is one cell of the result, and its digest is one stream of hashing.

Cases: a null conv_id is a conversation of its own; null turns come first and count for no gap; a null role or text is one
space. Rows of one turn are ordered by role and then by their text's digest, equal rows stand together and all but one are
duplicates. A row whose role begins with none of s, u, a, or is empty, can't be kept as it is. An empty table gives an empty
result; a text of any length is read whole; further columns may bear any name.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vapora.llm import common

#: Rows of a segment, as a power of two.
SEGMENT_BITS = 11
#: What edits cost; a truncated row that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The state that a role's initial leads to, by the state before: nothing yet, after s, after u, after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a state lacks, for insertions and new roles.
WANTED = "uuau"
ENDS = (0, 3)
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}

Layer = list[tuple[int, str] | None]


def _offer(layer: Layer, state: int, way: tuple[int, str]) -> None:
    if layer[state] is None or way < layer[state]:
        layer[state] = way


def _closed(layer: Layer) -> Layer:
    for _ in range(3):
        for state, way in enumerate(list(layer)):
            if way:
                _offer(layer, NEXT[state][WANTED[state]], (way[0] + INSERT, way[1] + "I"))
    return layer


def _after(layer: Layer, code: str) -> Layer:
    """The closed layer after a row: d has to be deleted, a capital is truncated, x is no role of the grammar."""
    out: Layer = [None] * 4
    own, more = code.lower(), TRUNCATED * code.isupper()
    for state, way in enumerate(layer):
        if way is None:
            continue
        cost, audit = way
        _offer(out, state, (cost + DELETE, audit + "D"))
        if code != "d":
            if own in NEXT[state]:
                _offer(out, NEXT[state][own], (cost + KEEP + more, audit + "K"))
            _offer(out, NEXT[state][WANTED[state]], (cost + REROLE + more, audit + "R"))
    return _closed(out)


START = _closed([(0, ""), None, None, None])


def answers(codes: str) -> list[Layer]:
    """For each entry state the least (cost, audit) to each exit state over a segment's rows."""
    out = []
    for entry in range(4):
        layer: Layer = [(0, "") if state == entry else None for state in range(4)]
        for code in codes:
            layer = _after(layer, code)
        out.append(layer)
    return out


def folded(segments: Iterable[list[Layer]]) -> tuple[int, list[str]]:
    """The least cost over segments in order, and the audit's pieces: that of the start, then each segment's."""
    ways: list[tuple[int, str, list[str]] | None] = [(w[0], w[1], [w[1]]) if w else None for w in START]
    for answer in segments:
        now: list[tuple[int, str, list[str]] | None] = [None] * 4
        for entry, way in enumerate(ways):
            for state, more in enumerate(answer[entry] if way else ()):
                if more:
                    cost, audit = way[0] + more[0], way[1] + more[1]
                    if now[state] is None or (cost, audit) < now[state][:2]:
                        now[state] = (cost, audit, [*way[2], more[1]])
        ways = now
    best = min(way for state, way in enumerate(ways) if way and state in ENDS)
    return best[0], best[2]


def written(state: int, codes: str, piece: str) -> tuple[list[str], list[str], int]:
    """For each row of a segment its edits, insertions before it first, and the initials that they leave; the state after it.

    Insertions behind the last row are one entry more.
    """
    edits, left, rows = [""], [""], iter(codes)
    for edit in piece:
        own = next(rows).lower() if edit != "I" else ""
        role = "" if edit == "D" else own if edit == "K" else WANTED[state]
        state = NEXT[state][role] if role else state
        edits[-1] += edit
        left[-1] += role
        if edit != "I":
            edits.append("")
            left.append("")
    if not edits[-1]:
        edits.pop(), left.pop()
    return edits, left, state


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema)


def _map(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    """df's rows given to f task by task, as dicts; ddl names the rows that it gives."""
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    return df.mapInArrow(lambda batches: _batches(f(_rows(batches)), schema), ddl)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_SEGMENT = "conv_id {conv}, segment long, codes string, illegal long, first string, last string, ways array<array<struct<cost:long,audit:string>>>"
_FOLDED = "conv_id {conv}, cost long, illegal long, audit string, pieces array<struct<segment:long,codes:string,state:int,piece:string>>"
_WRITTEN = "conv_id {conv}, segment long, edits array<string>, roles array<string>"


def _answer(segments: Iterator[dict]) -> Iterator[dict]:
    known: dict[str, list] = {}
    for s in segments:
        codes = s["codes"]
        if codes not in known:
            if len(known) == 4096:
                known.clear()
            known[codes] = [[way and {"cost": way[0], "audit": way[1]} for way in layer] for layer in answers(codes)]
        yield {"conv_id": s["conv_id"], "segment": s["segment"], "codes": codes, "illegal": _illegal(s["initials"]), "first": s["initials"][0], "last": s["initials"][-1], "ways": known[codes]}


def _fold(segments: Iterator[dict]) -> Iterator[dict]:
    """Conversations from their segments, which come in order; a null conv_id is one of them."""
    for _, group in itertools.groupby(segments, key=lambda s: (s["conv_id"] is None, s["conv_id"])):
        held, layers = [], []
        for s in group:
            layers.append([[way and (way["cost"], way["audit"]) for way in layer] for layer in s.pop("ways")])
            held.append(s)
        cost, parts = folded(layers)
        state, pieces = 0, []
        for k, s in enumerate(held):
            piece = (parts[0] if k == 0 else "") + parts[k + 1]
            pieces.append({"segment": s["segment"], "codes": s["codes"], "state": state, "piece": piece})
            state = written(state, s["codes"], piece)[2]
        illegal = sum(s["illegal"] for s in held) + sum(_illegal([a["last"], b["first"]]) for a, b in zip(held, held[1:]))
        yield {"conv_id": held[0]["conv_id"], "cost": cost, "illegal": illegal, "audit": "".join(parts), "pieces": pieces}


def _write(pieces: Iterator[dict]) -> Iterator[dict]:
    for p in pieces:
        edits, roles, _ = written(p["state"], p["codes"], p["piece"])
        yield {"conv_id": p["conv_id"], "segment": p["segment"], "edits": edits, "roles": roles}


@dataclass
class Repair:
    """rows: conv_id, place, k, role, text, edit of the repaired conversations, to be read by (conv_id, place, k).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.
    """

    rows: DataFrame
    report: DataFrame


def repair_conversations(conversations: DataFrame) -> Repair:
    """Repaired turns and a report of conversations with columns conv_id, turn, role and text."""
    spark = conversations.sparkSession
    common.small_batches(spark)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = rows.select(
        "*", F.monotonically_increasing_id().alias("uid"), F.unhex(F.sha2("text", 256)).alias("digest"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.left("role", F.lit(1)).alias("initial")
    )
    rows = common.materialize(rows, "turns")
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "uid"))["uid"].alias("uid")).select("uid", F.lit(True).alias("first"))
    marked = rows.drop("text").join(first, "uid", "left").withColumn("again", F.col("first").isNull())
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    letter = F.when(F.col("initial").isin(*ROLES), F.col("initial")).otherwise("x")
    code = F.when(F.col("blank") | F.col("again"), "d").when(F.col("cut"), F.upper(letter)).otherwise(letter)
    marked = marked.select("conv_id", "turn", "role", "digest", "again", "uid", "initial", fault.alias("fault"), code.alias("code"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "again", "uid")]
    placed = marked.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", "turn", "uid", "initial", "fault", "code", F.monotonically_increasing_id().alias("place"))
    placed = common.materialize(placed.withColumn("segment", F.shiftright("place", SEGMENT_BITS)), "places")

    conv = rows.schema["conv_id"].dataType.simpleString()
    listed = F.array_sort(F.collect_list(F.struct("place", "code", "initial")))
    segments = placed.groupBy("conv_id", "segment").agg(listed.alias("listed"))
    segments = segments.select("conv_id", "segment", F.array_join("listed.code", "").alias("codes"), F.col("listed.initial").alias("initials"))
    segments = _map(segments, _answer, _SEGMENT.format(conv=conv))
    segments = segments.repartition(common.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "segment")
    folds = common.materialize(_map(segments, _fold, _FOLDED.format(conv=conv)), "audits")

    turns = placed.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counts = turns.groupBy("conv_id").agg(gaps, *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    named = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = counts.unionByName(folds.select("conv_id", "illegal", "cost", "audit"), allowMissingColumns=True)
    report = both.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in named), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))

    # Edits by segment and row; insertions behind the last row go with it.
    pieces = _map(folds.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", "p.*"), _write, _WRITTEN.format(conv=conv))
    heads = placed.groupBy("conv_id", "segment").agg(F.min("place").alias("head"), F.max("place").alias("tail"))
    pieces = _null_safe(pieces, heads, ["conv_id", "segment"])
    edited = _null_safe(placed.select("conv_id", "segment", "place", "uid"), pieces, ["conv_id", "segment"])
    at = (F.col("place") - F.col("head")).cast("int")
    behind = F.when(F.col("place") == F.col("tail"), F.get("edits", at + 1))
    edited = edited.select("conv_id", "place", "uid", F.get("edits", at).alias("edits"), F.get("roles", at).alias("roles"), F.coalesce(behind, F.lit("")).alias("behind"), F.when(F.col("place") == F.col("tail"), F.get("roles", at + 1)).alias("more"))
    steps = F.concat("edits", "behind")
    roles = F.concat("roles", F.coalesce("more", F.lit("")))
    edited = edited.select("conv_id", "place", "uid", F.replace(steps, F.lit("D"), F.lit("")).alias("steps"), roles.alias("roles")).where("roles <> ''")
    told = edited.join(rows.select("uid", F.col("role").alias("own"), "text"), "uid")
    told = told.select("conv_id", "place", "own", "text", "roles", "steps", F.posexplode(F.split("steps", "")).alias("k", "edit"))
    given = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.substring("roles", F.col("k") + 1, F.lit(1)))
    repaired = told.select("conv_id", "place", "k", F.when(F.col("edit") == "K", F.col("own")).otherwise(given).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")
    return Repair(repaired, report)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and right joined on keys, of which nulls are equal."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    on = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys))
    return left.join(renamed, on).drop(*(f"right_{k}" for k in keys))


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    """SHA-256 of each conversation's `role:text` lines, which come in order; only the hash is held."""
    for (_, conv), group in itertools.groupby(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"])):
        sha = hashlib.sha256()
        for k, row in enumerate(group):
            sha.update(f"{chr(10) if k else ''}{row['role']}:{row['text']}".encode())
        yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired rows; conversations without a row are missing."""
    ordered = rows.repartition(common.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "k").select("conv_id", "role", "text")
    return _map(ordered, _digest, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


#: Out of 20 rows that are dropped, emptied, cut short, repeated and given the role user, one each.
OF = 20


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows damaged as the checksum of `conv_id:turn` says; a null is one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % OF
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = repair_conversations(damage(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select("conv_id").distinct()
    both = every.unionByName(done.report, allowMissingColumns=True).unionByName(digests(done.rows), allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return both.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))


def _oracle() -> str:
    """The search as a recursion over a conversation's rows; a way is a cost, an audit string and the lines written so far."""
    way = lambda s, cost, edit, line: f"{{'cost': v.{s}.cost + {cost}, 'audit': v.{s}.audit || '{edit}', 'lines': v.{s}.lines || {line}}}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    never = "CASE WHEN {} THEN {} ELSE {{'cost': 1000000000, 'audit': '', 'lines': ''}} END"
    line = lambda role: f"({role} || ':' || r.text || chr(10))"
    keep = lambda s, own: never.format(f"NOT gone AND own = '{own}'", way(s, "more", "K", line("r.role")))
    rerole = lambda s, role: never.format("NOT gone", way(s, "more + 1", "R", line(f"'{role}'")))
    delete = lambda s: way(s, 2, "D", "''")
    insert = lambda s, role: way(s, 5, "I", f"('{role}:' || chr(10))")
    steps = {
        "s0": least(delete("s0")),
        "s1": least(delete("s1"), keep("s0", "s")),
        "s2": least(delete("s2"), *(f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user")))),
        "s3": least(delete("s3"), keep("s2", "a"), rerole("s2", "assistant")),
    }
    close_u = least("v.s2", *(insert(s, "user") for s in ("s0", "s1", "s3")))
    close_a = least("v.s3", insert("s2", "assistant"))
    closed = lambda inner: f"SELECT v.* REPLACE ({close_a} AS s3) FROM (SELECT v.* REPLACE ({close_u} AS s2) FROM ({inner}) v) v"
    first = "SELECT conv, 0::BIGINT AS i, {'cost': 0, 'audit': '', 'lines': ''} AS s0, {'cost': 1000000000, 'audit': '', 'lines': ''} AS s1, {'cost': 1000000000, 'audit': '', 'lines': ''} AS s2, {'cost': 1000000000, 'audit': '', 'lines': ''} AS s3 FROM n"
    moved = f"SELECT v.conv, r.i, {', '.join(f'{sql} AS {s}' for s, sql in steps.items())} FROM v JOIN r ON r.conv = v.conv AND r.i = v.i + 1"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE crc_of AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n)),
k AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {OF} AS kind
  FROM conversations, crc_of),
g AS (SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
q AS (SELECT *, rtrim(text, {white}) AS kept, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM g),
p AS (SELECT *, kept = '' AS blank, right(kept, 1) NOT IN ('.', '!', '?') AS cut, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i FROM q),
r AS (SELECT conv, i, turn, role, text, left(role, 1) AS own, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS more, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated,
    CASE WHEN i > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM p),
n AS (SELECT conv, any_value(conv_id) AS conv_id FROM k GROUP BY conv),
v AS ({closed(first)} UNION ALL ({closed(moved)})),
t AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, sum(illegal) AS illegal, count(*) AS n FROM r GROUP BY conv),
e AS (SELECT v.conv, list_min([s0, s3]) AS best FROM v LEFT JOIN t ON t.conv = v.conv WHERE v.i = coalesce(t.n, 0))
SELECT n.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, best.cost::BIGINT AS cost, best.audit AS audit, sha256(CASE WHEN best.lines = '' THEN '' ELSE left(best.lines, length(best.lines) - 1) END) AS repaired_sha256
FROM n JOIN e ON e.conv = n.conv LEFT JOIN t ON t.conv = n.conv
"""


ORACLE_SQL = _oracle()
