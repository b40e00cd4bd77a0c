"""Fill-in-the-middle transformation: texts cut in prefix, middle and suffix at unit boundaries, and written in another order.

Units are lines, words (runs of white space and runs of the rest) or code points. One Aho-Corasick automaton goes over a text
once and reports only events: characters that change the class (line feeds, or white space) and sentinels. Between two events
there is a gap of one class, so units before an event are a count of events and gaps, and the place of the k-th unit's end is
looked up by rank among them; code points need no event at all. A text is plain, and left as it is, if it is empty, holds a
sentinel, or is drawn to be.

What is drawn comes from the digest of the seed and the id: the same document is cut alike in every run. Sentinels can't arise
where pieces and sentinels meet, since no sentinel begins with another's end, so restored() splits the output at them.

Cases: a null text is empty; a null id is an empty one; repeated rows are treated alike; an empty table gives an empty result;
a text of any length is read whole; further columns may bear any name.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import common

#: Prefix, suffix and middle are announced by these.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, PERCENT_CUT, PERCENT_SPM = 7, 100, 50
#: Characters that end a unit, or that are units of another class than the rest.
EVENTS = {"line": "\n", "word": "\x20\t\n\x0b\x0c\r", "char": ""}

_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


@functools.lru_cache(maxsize=8)
def automaton(unit: str, sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in EVENTS[unit]:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


def unit_ends(events: np.ndarray, length: int, unit: str) -> np.ndarray | None:
    """Ends of a text's units from the places of its class-changing characters; None for code points, which end everywhere."""
    if unit == "char":
        return None
    if unit == "line":
        return events + 1 if len(events) and events[-1] == length - 1 or not length else np.append(events + 1, length)
    before = np.concatenate(([-1], events))
    after = np.concatenate((events, [length]))
    gaps = after - before - 1 > 0  # a gap of the other class ends where the next event stands
    runs = events[np.diff(after) != 1] + 1 if len(events) else events  # a run of events ends where the next one isn't its neighbour
    last = [length] if len(events) and events[-1] == length - 1 else []
    return np.unique(np.concatenate((after[gaps], runs, last)).astype(np.int64))


def cut(text: str, draws: tuple[int, int, int, int], unit: str, sentinels: tuple[str, ...], percent_cut: int, percent_spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, and output of one text."""
    found = list(automaton(unit, sentinels).iter(text)) if text else []
    events = np.fromiter((at for at, sentinel in found if not sentinel), np.int64)
    ends = unit_ends(events, len(text), unit)
    n = len(text) if ends is None else len(ends)
    if not text or any(sentinel for _, sentinel in found) or draws[2] % 100 >= percent_cut:
        return n, "plain", None, None, text
    first, second = sorted(draw % (n + 1) for draw in draws[:2])
    a, b = (k if ends is None else int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    spm = draws[3] % 100 < percent_spm
    return n, "spm" if spm else "psm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, percent_cut: int = PERCENT_CUT, percent_spm: int = PERCENT_SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of each document."""
    if unit not in EVENTS or not all(sentinels) or len(set(sentinels)) != 3 or any(b.startswith(a[k:]) for a in sentinels for b in sentinels for k in range(1, len(a))):
        raise ValueError("units are line, word or char; sentinels differ, and none begins with another's end")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", common.SLICE):
            rows = batch.to_pydict()
            done = [cut(text or "", draws, unit, sentinels, percent_cut, percent_spm) for text, *draws in zip(rows["text"], *(rows[f"h{k}"] for k in range(1, 5)))]
            columns = [list(c) for c in zip(*done)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:]))], schema=_OUT)

    return common.id_and_text(docs).select("doc_id", "text", *draw).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""

    def joined(parts: Column) -> Column:
        prefix, suffix = (F.when(form == "psm", F.get(parts, 1)).otherwise(F.get(parts, 2)), F.when(form == "psm", F.get(parts, 2)).otherwise(F.get(parts, 1)))
        return F.concat(prefix, F.get(parts, 3), suffix)

    return F.when(form == "plain", output).otherwise(common.bind(F.split(output, "|".join(map(re.escape, sentinels)), -1), joined))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(common.documents(spark, sf_dir))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b FROM u),
f AS (SELECT doc_id, text, n, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 :], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""
