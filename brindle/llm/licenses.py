"""License scans by diagonal voting, with DataFrame operations only.

Texts and templates are sequences of words.  Every rolling pair of words of a
text is hashed and joined to the pairs of the templates (a fixed table of a few
hundred rows, broadcast); the joined strings must be equal too, so a collision
of hashes is no match.  A match votes for the diagonal
(template, place in text - place in template).

Exact phrases: a diagonal with the votes of all pairs is a place where the
phrase stands.  Longer templates: neighbouring diagonals (up to SLACK words
apart, as an inserted or missing word shifts the rest) are merged, and the span
is verified: it must hold at least LEAST of the template's pairs (short
templates: all), each counted once, in not much more words than the template
has.

A document's words are exploded where it is read and its votes are combined
before any shuffle, so a document or a phrase however frequent is no hot key.

Null texts have no words.  Rows are told apart by their place in the input, so
repeated rows and null doc_ids each get their own result.  Columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that diagonals of one span may be apart, least share of pairs, most words of a span per word of the template.
SLACK, LEAST, STRETCH = 3, 0.8, 1.4
#: Templates of up to so many pairs must be whole: an edit of theirs may name another licence.
SHORT = 8

# Exact phrases with their labels, then templates with labels of this scan.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you should have received a copy of the gnu lesser general public license along with this library", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: Words before A-Z are lower-cased: the same places, as lower-casing moves no boundary.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_pairs(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """template, label, exact, pairs (of the template), t_pos, t_pair, t_hash; template -1 marks every document."""
    rows = []
    for i, (text, label) in enumerate((*phrases, *templates)):
        words = re.findall(r"[0-9a-z]+", text)
        for j, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            rows.append((i, label, i < len(phrases), len(words) - 1, j, f"{a} {b}"))
    rows.append((-1, "", False, 1, 0, ""))
    names = ("template", "label", "exact", "pairs", "t_pos", "t_pair")
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(table)).withColumn("t_hash", F.xxhash64("t_pair"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def votes(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """row, doc_id, n_words, template, label, exact, pairs, diagonal, n (votes), seen (places in the template), low, high (places in the text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    w = F.col("w")
    pairs = F.when(F.col("n_words") > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    exploded = rows.select("row", "doc_id", "n_words", F.posexplode(F.array_prepend(pairs, F.lit(""))).alias("pos", "pair"))
    exploded = exploded.withColumn("pos", F.col("pos") - 1).withColumn("hash", F.xxhash64(F.lower("pair")))
    t = F.broadcast(template_pairs(docs.sparkSession, phrases, templates))
    matched = exploded.join(t, F.expr(f"hash = t_hash and translate(pair, '{UPPER}', '{LOWER}') = t_pair"))
    matched = matched.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("pos") - F.col("t_pos")))
    return matched.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "pairs", "diagonal").agg(
        F.count("*").alias("n"), F.collect_set("t_pos").alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )


def verified(v: DataFrame) -> DataFrame:
    """v with merged (the number of its group of neighbouring diagonals) and, per group, its share of pairs if its span holds, else 0."""
    order = Window.partitionBy("row", "template").orderBy("diagonal", "low")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > SLACK
    v = v.withColumn("merged", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    group = Window.partitionBy("row", "template", "merged")
    pairs = F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(group))))
    words = F.max("high").over(group) - F.min("low").over(group) + 2
    share = pairs / F.col("pairs")
    return v.withColumn("share", F.when((share >= F.when(F.col("pairs") <= SHORT, 1.0).otherwise(LEAST)) & (words <= STRETCH * (F.col("pairs") + 1)), share).otherwise(0.0))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    v = votes(docs, phrases, templates)
    base = F.col("exact") & (F.col("n") == F.col("pairs"))
    v = v.where((F.col("template") < 0) | ~F.col("exact") | base)
    v = verified(v)
    own = base | (~F.col("exact") & (F.col("share") > 0) & (F.col("template") >= 0))

    def joined(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    return (
        v.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(own).alias("labels"),
            F.max(F.when(base, 1.0).when(own, F.col("share")).otherwise(0.0)).cast("double").alias("score"),
        )
        .drop("row")
    )
