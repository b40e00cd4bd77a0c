"""Conversation repair, license scan and fill-in-the-middle against plain versions and on awkward tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vapora.llm import common, conversation_repair, fill_in_middle, license_scan

WELL_FORMED = re.compile("(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}


# --- 11 -----------------------------------------------------------------------


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation in order. The cheapest, then least, of all repairs, by best-first search."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(conversation_repair.WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, least_of, best = [(0, "", 0, "", ())], {}, None
    while heap:
        cost, audit, k, initials, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if k == len(rows) and WELL_FORMED.fullmatch(initials):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        # what follows depends on the row and the last initial alone
        key = (k, initials[-1:])
        if least_of.setdefault(key, (cost, audit)) < (cost, audit):
            continue
        ways = [(5, "I", k, role, f"{ROLES[role]}:") for role in "ua"]
        if k < len(rows):
            _, role, text = rows[k]
            ways.append((2, "D", k + 1, "", None))
            if faults[k] in ("", "truncated"):
                more = 5 * (faults[k] == "truncated")
                ways.append((more, "K", k + 1, role[:1] or "?", f"{role}:{text}"))
                ways += [(1 + more, "R", k + 1, r, f"{ROLES[r]}:{text}") for r in "ua"]
        for more, edit, at, initial, line in ways:
            if (now := initials + initial) and not re.fullmatch("s?(ua)*u?", now):
                continue
            heapq.heappush(heap, (cost + more, audit + edit, at, now, (*lines, line) if line is not None else lines))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def plain_damage(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
    return [] if kind == 0 else [row] * (1 + (kind == 3))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def reported(repair):
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    shas = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(repair.rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*(r[c] for c in counts), shas.get(r.conv_id, empty)) for r in repair.report.collect()}


def test_repairs_equal_an_exhaustive_search(spark):
    draw = random.Random(3)
    texts = ["Hello.", "Well", "", " \t", "Is it?", "No stop ", "It is!", "Fine.  "]
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(1, 8)):
            rows.append((conv, draw.choice([turn, turn, turn, None, 2]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), draw.choice(texts)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = reported(conversation_repair.repair_conversations(df))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        assert got[conv] == plain_repair(in_order([r[1:] for r in group])), conv


def test_op11_equals_a_plain_version(spark, sf):
    original = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        original.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in conversation_repair.op11_conversation_repair(spark, sf).collect()}
    assert set(got) == set(original)
    for conv, rows in original.items():
        assert got[conv] == plain_repair(in_order([d for r in rows for d in plain_damage(*r)]))


def test_repairs_of_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string, place string, uid string, code string, segment string"
    rows = [(None, None, None, None), (None, 1, "user", "Ä."), (1, None, "user", "x"), (1, 0, "assistant", "Yes."), (2, 5, "user", "A." * 200_000), (2, 9, "assistant", "B."), (2, 9, "assistant", "B."), (3, 1, None, "C.")]
    df = spark.createDataFrame([(*r, "p", "u", "c", "s") for r in rows], schema)
    got = reported(conversation_repair.repair_conversations(df))
    for conv in (None, 1, 2, 3):
        assert got[conv] == plain_repair(in_order([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]))
    none = conversation_repair.repair_conversations(df.where("false"))
    assert none.report.count() == 0 and none.rows.count() == 0


def test_one_conversation_with_most_rows_is_cut_in_segments(spark, monkeypatch):
    """The same repair whether a conversation is one segment or hundreds, over several tasks."""
    draw = random.Random(5)
    rows = [(7, t, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes.", "No", f"{t}.", f"{t}!", f"{t}"])) for t in range(3000)] + [(c, t, ("user", "assistant")[t], "Hi.") for c in range(20) for t in range(2) if c != 7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = reported(conversation_repair.repair_conversations(df))
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", 4)
    cut = conversation_repair.repair_conversations(df)
    assert reported(cut) == whole
    lines = cut.rows.where("conv_id = 7").orderBy("place", "k").collect()
    assert WELL_FORMED.fullmatch("".join(r.role[0] for r in lines)) and "".join(r.edit for r in lines) == whole[7][6].replace("D", "")


def test_answers_of_segments_compose():
    for codes in map("".join, itertools.product("suaUxd", repeat=4)):
        parts = conversation_repair.folded([conversation_repair.answers(codes[:2]), conversation_repair.answers(codes[2:])])
        whole = conversation_repair.folded([conversation_repair.answers(codes)])
        assert (parts[0], "".join(parts[1])) == (whole[0], "".join(whole[1]))


# --- 12 -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan_equals_a_plain_version(spark):
    draw = random.Random(11)
    notice = [t for t, _ in license_scan.NOTICES]
    texts = [None, "", "...", "under the MIT license", "Under-the mit_License!", "underthe mit license", "Apache License, Version 2.0; APACHE license VERSION 2", "CC BY-NC CC BY-NC CC BY NC", "cc by ñc", "under the mit licenſe Key", "x " * 50_000 + "cc by-nc"]
    for _ in range(60):
        words = draw.choice(notice).split(" ")
        for _ in range(draw.randrange(0, len(words) // 3 + 2)):
            k = draw.randrange(len(words))
            words[k : k + 1] = draw.choice([[], ["neu"], [words[k], "und"], [words[k]]])
        texts.append(" ".join(["der"] * draw.randrange(9) + words + ["die"] * draw.randrange(5) + (words if draw.random() < 0.3 else [])))
    got = {r.doc_id: r for r in spark_rows(spark, texts)}
    for n, text in enumerate(texts):
        words = plain_words(text)
        places, labels, score = [], set(), 0.0
        for phrase, label in license_scan.PHRASES:
            p = phrase.split(" ")
            places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        for notice_text, label in license_scan.NOTICES:
            p = notice_text.split(" ")
            hits = sorted((k - j, k, j) for k in range(len(words) - 2) for j in range(len(p) - 2) if words[k : k + 3] == p[j : j + 3])
            spans = []
            for h in hits:
                if spans and h[0] - spans[-1][-1][0] <= license_scan.SLACK:
                    spans[-1].append(h)
                else:
                    spans.append([h])
            for span in spans:
                share = len({j + k for _, _, j in span for k in range(3)}) / len(p)
                if share >= license_scan.LEAST and max(h[1] for h in span) + 3 - min(h[1] for h in span) <= license_scan.STRETCH * len(p):
                    labels.add(label)
                    score = max(score, share)
        base = {label for _, label in places}
        starts = [k for k, _ in places]
        assert (got[n].n_words, got[n].n_base, got[n].first_word, got[n].last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None)), text
        assert (got[n].base_labels, got[n].labels) == (",".join(sorted(base)), ",".join(sorted(base | labels))), text
        assert got[n].score == (1.0 if places else score)


def spark_rows(spark, texts):
    df = spark.createDataFrame([(n, t, "r", 3) for n, t in enumerate(texts)], "doc_id long, text string, template string, place int")
    path = common.materialize(df, "licenses").vapora_path
    spark.read.parquet(path).write.mode("overwrite").parquet(f"{path}-sf/documents.parquet")
    return license_scan.op12_license_scan(spark, f"{path}-sf").collect()


def test_license_scan_of_awkward_tables(spark):
    df = spark.createDataFrame([(None, "under the mit license", "r"), (1, None, "r"), (1, "cc by nc", "r"), (1, "cc by nc", "r")], "doc_id long, text string, row string")
    spans = license_scan.license_spans(df)
    assert spans.select("row").distinct().count() == 4 and spans.where("places > 0 AND doc_id = 1").count() == 2
    assert spans.where("places > 0 AND doc_id IS NULL").count() == 1
    assert license_scan.license_spans(df.where("false")).count() == 0


def test_license_scan_has_no_python(spark, sf):
    plan = license_scan.op12_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 13 -----------------------------------------------------------------------

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"[\s\S]"}
TEXTS = [
    None, "", "one line", "a\nb\nc", "a\n\n\nb\n", "\n", "\n\n", "  two  words \n", "<P>", "a <S> b\nc", "<M", "<<P\n<\n<S", "P>\nS>\n>", "été 😀\nñ\n中文 ende", "x" * 300_000 + "\n" + "y\n" * 20_000, " ", "w", "w ", " w",
]


@pytest.mark.parametrize("unit", sorted(UNITS))
@pytest.mark.parametrize(("percent_cut", "percent_spm"), [(100, 50), (60, 100)])
def test_fill_in_middle_equals_a_plain_version(spark, unit, percent_cut, percent_spm):
    rows = [(n, t, "u", 1) for n, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, h1 int")
    done = fill_in_middle.fill_in_middle(df, unit, percent_cut=percent_cut, percent_spm=percent_spm)
    got = {r.doc_id: r for r in done.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()}
    forms = set()
    for n, text, _, _ in rows:
        text = text or ""
        units, h = re.findall(UNITS[unit], text), hashlib.sha256(f"7:{n}".encode()).hexdigest()
        r = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in r[:2])
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or r[2] % 100 >= percent_cut else "spm" if r[3] % 100 < percent_spm else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want = (len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), output, text)
        assert (got[n].n, got[n].form, got[n].prefix_chars, got[n].middle_chars, got[n].output, got[n].back) == want
        forms.add(form)
    assert len(forms) > 1


def test_fill_in_middle_of_awkward_tables(spark):
    df = spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, None)], "doc_id long, text string")
    rows = fill_in_middle.fill_in_middle(df).collect()
    assert len(rows) == 4 and len({(r.output, r.form) for r in rows if r.doc_id == 1}) == 1
    assert fill_in_middle.fill_in_middle(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(df, sentinels=("<a>", ">b", "c"))
