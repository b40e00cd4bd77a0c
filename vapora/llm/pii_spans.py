"""Personal data in texts, in DataFrame functions alone.

Regular expressions propose spans of each kind; validators confirm them (Luhn for cards, mod-97 for bank accounts, ranges
and digit counts for addresses and phones); words close to a span raise or lower its score. Kinds beside the base ones need a
score of LEAST_SCORE: one without a checksum counts only with its words nearby, one with a checksum doesn't beside words
that speak against it.

A text is split at a kind's matches once; a match starts where the pieces and matches before it end, so positions need no
search, only running sums, taken in blocks. The patterns are possessive and start only at the first character of a run or at
the last match's end: they give the same matches as their plain forms, without recursion or quadratic scans of long runs. That
of cards leaves out runs of under 12 digits, which are no cards.

Cases: a null text has no spans; an empty table gives an empty result; repeated rows are judged alike, each for itself;
further columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import common

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SECRET = r"[0-9A-Fa-f]{32,}"

#: Score of a confirmed span, what a word for or against it adds, and the least score of a kind that isn't a base kind.
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3, "secret": 0.3}
CONTEXT_SCORE, LEAST_SCORE, CONTEXT_CHARS = 0.3, 0.5, 40
#: Whole words, or beginnings of words where a * stands, that speak for a kind, and those that speak against any.
CONTEXT = {
    "email": "e-mail email mail* contact* write schreib* correo courriel",
    "ip": "ip host* server* address* adresse* login*",
    "card": "card* visa mastercard credit* karte* kreditkarte* carte* tarjeta*",
    "phone": "phone* call* tel telephone telefon* mobile fon llam* appel*",
    "iban": "iban account* bank* konto* compte* cuenta*",
    "ssn": "ssn social security sozialversicherung*",
    "secret": "token* secret* key keys apikey password* passwort* bearer credential* auth*",
}
AGAINST = "version* isbn part* order* serial* sku invoice* build* release* example*"


def word_pattern(words: str) -> str:
    """A pattern that finds any of the words, in lower case, as whole words."""
    return r"(^|[^a-z0-9])(" + "|".join(w.replace("*", "[a-z]*") for w in words.split()) + ")([^a-z0-9]|$)"


#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    value = F.transform(_chars(F.reverse(number)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number, its first four characters moved to the end, is 1 modulo 97."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(c >= "A", a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97) == 1


def _ip_ok(hit: Column) -> Column:
    return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def _card_ok(hit: Column) -> Column:
    n = F.length(digits(hit))
    return F.when(n.between(12, 19), luhn(digits(hit))).otherwise(F.lit(False))


def _phone_ok(hit: Column) -> Column:
    return F.length(digits(hit)).between(9, 15)


def _iban_ok(hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))


#: Kind: pattern, what a text with a match must match first, validator, whether letters and digits may not touch the match.
RULES: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column], bool]] = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda h: F.lit(True), False),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip_ok, False),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _card_ok, False),
    "phone": (PHONE, lambda t: t.contains("+"), _phone_ok, False),
    "iban": (IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), _iban_ok, True),
    "ssn": (SSN, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), lambda h: F.lit(True), True),
    "secret": (SECRET, lambda t: t.rlike(SECRET), lambda h: h.rlike("[0-9]") & h.rlike("[A-Fa-f]"), True),
}
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def running_sums(x: Column, block: int = 128) -> Column:
    """Sums of a non-empty array's elements up to each: sums of blocks, then within the element's own block."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: total(F.slice(x, b * block + 1, F.lit(block))))
    before = lambda s: F.transform(s, lambda v, b: total(F.slice(s, F.lit(1), b)))
    own = lambda b: F.transform(x, lambda v, i: F.get(b, F.floor(i / block).cast("int")) + total(F.slice(x, i - i % block + 1, i % block + 1)))
    return common.bind(common.bind(sums, before), own)


def _spans(kind: str, pieces: Column, hits: Column) -> Column:
    """Spans of one kind from the pieces around its matches."""
    _, _, ok, alone = RULES[kind]

    def listed(both: Column) -> Column:
        p, h = both["pieces"], both["hits"]
        step = F.transform(h, lambda x, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(h, i - 1)), F.lit(0)))
        parts = lambda starts: F.transform(
            h,
            lambda x, i: F.struct(x.alias("hit"), F.get(starts, i).cast("int").alias("start"), F.right(F.get(p, i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(p, i + 1), F.lit(CONTEXT_CHARS)).alias("after")),
        )
        return common.bind(common.bind(step, lambda x: running_sums(x)), parts)

    found = common.bind(F.struct(pieces.alias("pieces"), hits.alias("hits")), listed)
    good = F.filter(found, lambda s: ok(s["hit"]) & (~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]") if alone else F.lit(True)))
    has = lambda s, words: F.lower(F.concat_ws(" # ", s["before"], s["after"])).rlike(word_pattern(words)).cast("int") * CONTEXT_SCORE
    scored = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (s["start"] + F.length(s["hit"])).cast("int").alias("end"), F.lit(kind).alias("kind"), F.round(F.lit(SCORES[kind]) + has(s, CONTEXT[kind]) - has(s, AGAINST), 2).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)


def _with_spans(df: DataFrame, text: str) -> DataFrame:
    """row, df's columns as a struct so that none can clash, and spans."""
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    nothing = F.array().cast("array<string>")
    for kind, (_, may, _, _) in RULES.items():
        df = df.withColumn(f"may_{kind}", may(F.col("t")))
    df = df.select("*", *(F.when(F.col(f"may_{k}"), F.regexp_extract_all("t", F.lit(r[0]), F.lit(0))).otherwise(nothing).alias(f"hits_{k}") for k, r in RULES.items()))
    df = df.select("*", *(F.when(F.size(f"hits_{k}") > 0, F.split("t", r[0], -1)).otherwise(nothing).alias(f"pieces_{k}") for k, r in RULES.items()))
    df = df.select("row", *(F.when(F.size(f"hits_{k}") > 0, _spans(k, F.col(f"pieces_{k}"), F.col(f"hits_{k}"))).otherwise(F.array().cast(SPAN)).alias(f"spans_{k}") for k in RULES))
    return df.select("row", F.array_sort(F.concat(*(F.col(f"spans_{k}") for k in RULES))).alias("spans"))


def find_pii(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with its texts' spans, by start and then kind: code points, end exclusive. A column of df named out is replaced."""
    return _with_spans(df, text).select(*(F.col("row")[c].alias(c) for c in df.columns if c != out), F.col("spans").alias(out))


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its texts replaced by its kind in angle brackets; spans that overlap give one mark."""
    own = F.col("row")[text]
    t = F.coalesce(own.cast("string"), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(a["out"]).alias("out"),
    )
    finish = lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t)))
    masked = F.when(F.size("spans") > 0, F.aggregate("spans", begin, step, finish)).otherwise(own)
    return _with_spans(df, text).select(*((masked if c == text else F.col("row")[c]).alias(c) for c in df.columns))


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.id_and_text(common.documents(spark, sf_dir))).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    least = F.array_min(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), least.alias("least_score"))


def _oracle() -> str:
    """Plain patterns, since the oracle's matcher needs no guard against recursion."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PHONE,
        "iban": IBAN,
        "ssn": SSN,
        "secret": SECRET,
    }
    number = "regexp_replace(s.hit, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({number}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({number})[i]::INT WHEN reverse({number})[i]::INT > 4 THEN reverse({number})[i]::INT * 2 - 9 ELSE reverse({number})[i]::INT * 2 END)) % 10 = 0"
    account = "replace(s.hit, ' ', '')"
    value = "CASE WHEN c >= 'A' THEN (ord(c) - 55)::VARCHAR ELSE c END"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(s.hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS BIGINT), 0) > 255)) = 0",
        "card": f"length({number}) BETWEEN 12 AND 19 AND {luhn_sql}",
        "phone": f"length({number}) BETWEEN 9 AND 15",
        "iban": f"length({account}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(array_to_string(list_transform(string_split({account}[5:] || {account}[:4], ''), lambda c: {value}), ''), '.'), lambda d: d::BIGINT)), lambda a, d: (a * 10 + d) % 97) = 1",
        "ssn": "true",
        "secret": "regexp_matches(s.hit, '[0-9]') AND regexp_matches(s.hit, '[A-Fa-f]')",
    }
    parts = []
    for kind, pattern in plain.items():
        alone = "AND NOT regexp_matches(s.before, '[A-Za-z0-9]$') AND NOT regexp_matches(s.after, '^[A-Za-z0-9]')" if RULES[kind][3] else ""
        parts.append(f"""
  SELECT doc_id, s.start AS a, {KINDS.index(kind)} AS o, s.start + length(s.hit) AS b, '{kind}' AS kind,
    round({SCORES[kind]} + CASE WHEN regexp_matches(lower(s.before || ' # ' || s.after), '{word_pattern(CONTEXT[kind])}') THEN {CONTEXT_SCORE} ELSE 0 END - CASE WHEN regexp_matches(lower(s.before || ' # ' || s.after), '{word_pattern(AGAINST)}') THEN {CONTEXT_SCORE} ELSE 0 END, 2)::DOUBLE AS score
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'hit': h[i], 'start': coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0), 'before': right(p[i], {CONTEXT_CHARS}), 'after': left(p[i + 1], {CONTEXT_CHARS})}})) AS s
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS p FROM t))
  WHERE {ok[kind]} {alone}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT * FROM f WHERE o < {len(BASE)} OR score >= {LEAST_SCORE}),
l AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o < {len(BASE)}), '') AS base, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o), '') AS spans, count(*) AS n_spans, min(score) AS least_score
  FROM g GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, least_score
FROM t LEFT JOIN l ON t.doc_id = l.doc_id
"""


ORACLE_SQL = _oracle()
