"""Scan of texts for license notices by diagonal voting, in DataFrame functions alone.

Every rolling K-gram of a document's words is joined, by its hash, to the places of the same K-gram in templates; the words
themselves are compared too, so no hash collision votes. A vote's diagonal is its place in the document less its place in the
template: an untouched copy votes on one diagonal, and a word more or less moves the rest of a copy to a neighbouring one.
Votes are counted by diagonal, diagonals at most SLACK apart are merged to a span, and a span is verified: it must hold a share
of LEAST of the template's words and not be longer than STRETCH times the template. Phrases are templates that must stand word
for word: all K-grams on one diagonal.

A document goes through in one scan: beside its K-grams it sends one row without a K-gram, which carries it through the join
to the grouping by document, so nothing is read or joined twice and only votes are shuffled.

Cases: a null text is empty and has no words; a null id is a document like any other; rows, repeated ones too, are scanned
each for itself; an empty table gives an empty result; a text of any length is scanned whole; further columns may bear any
name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.llm import common

#: Words of a K-gram; the phrases have three at least.
K = 3
SLACK, LEAST, STRETCH = 3, 0.7, 1.5
#: Characters that are in no word.
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Phrases that must stand word for word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Common notices of licenses, in words as they are compared, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("all rights reserved no part of this publication may be reproduced", "reserved"),
)


def templates(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """A row per K-gram of each template: template, label, exact, words, at, gram."""
    listed = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(n < len(phrases)).alias("exact"), F.split(F.lit(text), " ").alias("w")) for n, (text, label) in enumerate((*phrases, *notices))]
    if any(len(text.split(" ")) < K for text, _ in (*phrases, *notices)):
        raise ValueError(f"a template has {K} words at least")
    rows = spark.range(1).select(F.inline(F.array(*listed)))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: F.array_join(F.slice("w", i + 1, F.lit(K)), " "))
    return rows.select("template", "label", "exact", F.size("w").alias("words"), F.posexplode(grams).alias("at", "gram"))


def words(text: str):
    """Column of a text's words, A to Z in lower case."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # lower() also changes other letters, but only the Kelvin sign to one of a to z
    low = F.when(t.contains("\u212a"), F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(t))
    return F.filter(F.split(low, OTHER + "+", -1), lambda w: w != "")


def license_spans(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Spans of every document: row, doc_id, n_words, template, label, exact, first, last (places of a phrase that stands word for word, the smallest and largest start), places, begin, end (words, end exclusive), score, verified.

    A document has a row without a template besides.
    """
    spark = docs.sparkSession
    of = templates(spark, phrases, notices)
    rows = common.id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("w"))
    gram = lambda w: F.transform(w, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, K))))
    every = F.concat(F.array(F.lit(None).cast("string")), gram(F.col("w")))
    grams = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(every).alias("place", "gram")).withColumnRenamed("gram", "own")
    hashed = F.broadcast(of.withColumn("hash", F.xxhash64("gram")))
    votes = grams.join(hashed, (F.xxhash64("own") == F.col("hash")) & (F.col("own") == F.col("gram")), "left").where("place = 0 OR template IS NOT NULL")
    word = F.col("place") - 1
    votes = votes.select("row", "doc_id", "n_words", "template", "label", "exact", "words", "at", word.alias("word"), (word - F.col("at")).alias("diagonal"))
    # From here on all is grouped by document: one exchange serves every step.
    votes = votes.repartition("row")
    own = ["row", "doc_id", "n_words", "template", "label", "exact", "words"]
    diagonals = votes.groupBy(*own, "diagonal").agg(F.count("at").alias("votes"), F.collect_set("at").alias("seen"), F.min("word").alias("begin"), (F.max("word") + K).alias("end"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > SLACK).cast("int")
    merged = diagonals.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("span", F.sum("apart").over(by))
    whole = F.col("exact") & (F.col("votes") == F.col("words") - K + 1)
    start = F.when(whole, F.col("diagonal"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("seen")), lambda at: F.sequence(at, at + K - 1)))))
    spans = merged.groupBy(*own, "span").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count(start).alias("places"), F.min("begin").alias("begin"), F.max("end").alias("end"), covered.alias("covered"))
    score = F.when(F.col("template").isNotNull(), F.col("covered") / F.col("words"))
    fits = F.when(F.col("exact"), F.col("places") > 0).otherwise((score >= LEAST) & (F.col("end") - F.col("begin") <= F.col("words") * STRETCH))
    return spans.select(*own[:-1], "first", "last", "places", "begin", "end", score.alias("score"), F.coalesce(fits, F.lit(False)).alias("verified"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = license_spans(common.documents(spark, sf_dir))
    listed = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    done = spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum("places").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        listed(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        listed(F.when(F.col("verified"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("score"))), F.lit(0.0)).alias("score"),
    )
    return done.drop("row")


def _oracle() -> str:
    rows = lambda listed: ", ".join(f"({n}, '{text}', '{label}')" for n, (text, label) in enumerate(listed))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT label, string_split(text, ' ') AS p FROM (VALUES {rows(PHRASES)}) x(n, text, label)),
notices AS (SELECT n, label, string_split(text, ' ') AS p FROM (VALUES {rows(NOTICES)}) x(n, text, label)),
b AS (SELECT id, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS place FROM d, phrases),
g AS (SELECT id, unnest(list_transform(range(len(w) - {K - 1}), lambda i: {{'word': i, 'gram': array_to_string(w[i + 1 : i + {K}], ' ')}})) AS g FROM d),
t AS (SELECT n, label, len(p) AS words, unnest(list_transform(range(len(p) - {K - 1}), lambda i: {{'pos': i, 'gram': array_to_string(p[i + 1 : i + {K}], ' ')}})) AS t FROM notices),
h AS (SELECT id, n, label, words, g.word AS word, t.pos AS pos, g.word - t.pos AS diagonal FROM g JOIN t ON g.gram = t.gram),
s AS (SELECT *, sum(apart) OVER (PARTITION BY id, n ORDER BY diagonal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, n ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS apart FROM h)),
c AS (SELECT id, label, count(DISTINCT pos + k) / any_value(words) AS score, max(word) + {K} - min(word) AS length, any_value(words) AS words FROM s, range({K}) r(k) GROUP BY id, n, label, span),
m AS (SELECT id, label, score FROM c WHERE score >= {LEAST} AND length <= words * {STRETCH} UNION ALL SELECT id, label, 1.0 FROM b),
base AS (SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY id),
method AS (SELECT id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM m GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (id) LEFT JOIN method USING (id)
"""


ORACLE_SQL = _oracle()
