"""License scans in built-in functions, by diagonal voting.

All rolling word pairs of the documents are joined to the pairs of a few templates, which have a fixed number of
words. A document position less its template position is a diagonal; the hits on a diagonal are its votes, all within
the length of the template. Neighbouring diagonals, apart by inserted or missing words, are merged as far as DRIFT
words, so that a span is at most that much longer than its template; it is verified by the share of the template's pairs
that it holds. The phrases of the contract are templates that need all their pairs on one diagonal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted

#: The words of the contract, after lower-casing: everything but ASCII letters and digits, up to U+007F, separates.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels of the contract.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Sentences by which public licenses are named or known.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

#: The diagonals of one span are at most this far apart; the share of a template's pairs that a span needs for its label.
DRIFT, LEAST_SHARE = 6, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_pairs(spark: SparkSession, phrases: list = PHRASES, sentences: list = SENTENCES) -> DataFrame:
    """(template, label, base, pairs, tpos, h, t1, t2): a row per word pair of a template; at most 63 pairs each."""
    rows = []
    for k, (text, label, base) in enumerate([(t, lab, True) for t, lab in phrases] + [(t, lab, False) for lab, t in sentences]):
        words = [w for w in re.split(NOT_WORD, text.lower()) if w]
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a template must have 2 to 64 words: {text!r}")
        rows += [(k, label, base, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, tpos int, t1 string, t2 string")
    return made.withColumn("h", F.xxhash64("t1", "t2"))


def licenses(docs: DataFrame, phrases: list = PHRASES, sentences: list = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts all places where the words of a phrase stand consecutively; first_word and last_word are the
    smallest and the largest of their starts, null without any. labels adds those of spans that hold LEAST_SHARE of a
    sentence; score is the greatest share, 1 where a phrase stands. A null text is empty and has no words. One row per
    row of docs; rows equal in doc_id and text are worked on as one. A null doc_id is an id like any other. An empty
    table gives an empty result. Texts may be of any length: their word pairs are rows.
    """
    spark = docs.sparkSession
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD), "")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("key"), words.alias("w"))
    # arrays_zip pads the shorter array, so each document's last row has no second word: it carries the number of words
    pair = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("w2"))
    pairs = rows.select("doc_id", "key", F.posexplode_outer(pair).alias("at", "p")).select("doc_id", "key", "at", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))
    templates = F.broadcast(template_pairs(spark, phrases, sentences))  # its size is that of the two lists above
    hit = pairs.join(templates, (F.xxhash64("w1", "w2") == F.col("h")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    hit = hit.where(F.col("w2").isNull() | F.col("h").isNotNull())
    # one row per document, template and diagonal; the row without template is the document's last
    vote = hit.groupBy("doc_id", "key", "template", "label", "base", "pairs", F.when(F.col("h").isNotNull(), F.col("at") - F.col("tpos")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("seen"), F.max(F.coalesce(F.col("at") + 1, F.lit(0))).alias("last"), F.count("*").alias("rows")
    )
    along = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    whole = F.when(F.col("base") & (F.bit_count("seen") == F.col("pairs")), F.col("diagonal"))
    share = F.when(F.col("base"), F.when(F.col("whole").isNotNull(), 1.0)).otherwise(F.bit_count("near") / F.col("pairs"))
    span = vote.withColumns({"near": F.bit_or("seen").over(along), "whole": whole}).withColumn("share", share)
    found = F.when(F.col("share") >= LEAST_SHARE, F.col("label"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  at most one for each label
    return (
        span.groupBy("doc_id", "key")
        .agg(
            F.max(F.when(F.col("template").isNull(), F.col("last"))).cast("long").alias("n_words"),
            F.count("whole").alias("n_base"),
            F.min("whole").cast("long").alias("first_word"),
            F.max("whole").cast("long").alias("last_word"),
            joined(F.when(F.col("whole").isNotNull(), F.col("label"))).alias("base_labels"),
            joined(found).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
            # every row of docs has one last row
            F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("rows"),
        )
        .withColumn("rows", F.explode(F.sequence(F.lit(1), "rows")))
        .drop("key", "rows")
    )


def licenses_sql() -> str:
    """The same for tables without null or repeated ids, in DuckDB's SQL: pairs of words compared, no hashes."""
    every = [(t, lab, True) for t, lab in PHRASES] + [(t, lab, False) for lab, t in SENTENCES]
    values = ", ".join(f"({k}, '{label}', {base}, '{text}')" for k, (text, label, base) in enumerate(every))
    return f"""
    WITH t AS (SELECT template, label, base, string_split(words, ' ') AS ws FROM (VALUES {values}) AS v(template, label, base, words)),
    tp AS (SELECT template, label, base, len(ws) - 1 AS pairs, i AS tpos, ws[i + 1] AS t1, ws[i + 2] AS t2 FROM (SELECT *, unnest(range(len(ws) - 1)) AS i FROM t)),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT doc_id, place, ws[place + 1] AS w1, ws[place + 2] AS w2 FROM (SELECT *, unnest(range(greatest(len(ws) - 1, 0))) AS place FROM d)),
    h AS (SELECT DISTINCT doc_id, template, label, base, pairs, place - tpos AS diagonal, tpos FROM p JOIN tp ON w1 = t1 AND w2 = t2),
    g AS (SELECT a.doc_id, a.template, a.label, a.base, a.pairs, a.diagonal, count(DISTINCT b.tpos) AS n FROM (SELECT DISTINCT doc_id, template, label, base, pairs, diagonal FROM h) AS a
          JOIN h AS b ON a.doc_id = b.doc_id AND a.template = b.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + CASE WHEN a.base THEN 0 ELSE {DRIFT} END GROUP BY ALL),
    s AS (SELECT *, base AND n = pairs AS whole, CASE WHEN NOT base THEN n / pairs WHEN n = pairs THEN 1.0::DOUBLE END AS share FROM g),
    r AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word, max(share) AS score,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {LEAST_SHARE}) AS labels FROM s GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (doc_id)"""
