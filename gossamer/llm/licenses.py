"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of a document is hashed and joined with the places of
the templates' pairs.  A match votes for its diagonal (place in the document
less place in the template); votes are added up for each diagonal, neighbouring
diagonals of a template (at most `gap` apart: a word was added or lost) are
merged, and a merged span is verified: it must hold a large enough share of
the template's distinct pairs and be about as long.  Base phrases must stand
word for word on one diagonal.  Hash matches are confirmed by the words.

One sentinel pair for each row carries n_words through the same pass, so texts
are read once and never shuffled.  The templates are constants of a few kB, the
only thing that is broadcast.

Edges: null, empty and word-less texts have no words and score 0; A-Z alone
are lower-cased for the comparison; repeated rows (equal doc_id and text) are
matched together and returned each; null doc_ids are kept; overlapping phrases
count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (label, phrase): every place counts.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, statement, least share of its pairs).
STATEMENTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.7),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.7),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.7),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.7),
    ("lgpl", "gnu lesser general public license", 1.0),
    ("agpl", "gnu affero general public license", 1.0),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 0.7),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.7),
    ("cc-by", "licensed under cc by 4 0", 1.0),
    ("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    ("cc-by-nd", "licensed under cc by nd 4 0", 1.0),
)
#: All ASCII characters but letters and digits separate words.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """hash, template, place, first, second, label, pairs (of the template), share, base; and the sentinel, template -1."""
    rows = [("", "", -1, 0, "", 0, 0.0, False)]
    for k, (label, phrase, share, base) in enumerate([(x, p, 1.0, True) for x, p in BASE] + [(*s, False) for s in STATEMENTS]):
        words = phrase.split()
        rows += [(a, b, k, i, label, len(words) - 1, share, base) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "first string, second string, template int, place int, label string, pairs int, share double, base boolean").withColumn("hash", F.xxhash64("first", "second"))


def scan(docs: DataFrame, gap: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's pairs in any merged span.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The Kelvin sign is the one other character whose lower case is an ASCII letter.
    lower = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    words = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.array_remove(F.split(lower, SEPARATORS), "").alias("words")).withColumn("n_words", F.size("words").cast("long"))
    pairs = F.expr("if(n_words < 2, array(xxhash64('', '')), concat(array(xxhash64('', '')), transform(sequence(1, cast(n_words as int) - 1), i -> xxhash64(words[i - 1], words[i]))))")
    known = templates(docs.sparkSession)
    hits = (
        words.select("doc_id", "text_hash", "n_words", "words", F.posexplode(pairs).alias("at", "hash"))
        .join(F.broadcast(known), "hash")
        .where(F.expr("(template = -1 and at = 0) or (template >= 0 and at > 0 and words[at - 1] = first and words[at] = second)"))
        .select("doc_id", "text_hash", "n_words", "template", "place", "pairs", "share", "base", "label", (F.col("at") - 1 - F.col("place")).alias("diagonal"))
    )
    doc = ["doc_id", "text_hash", "n_words"]
    about = ["pairs", "share", "base", "label"]
    votes = hits.groupBy(*doc, "template", "diagonal", "place").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in about))
    along = Window.partitionBy(*doc, "template").orderBy("diagonal", "place")
    apart = (F.col("diagonal") - F.lag("diagonal", 1).over(along)) > F.when(F.col("base"), 0).otherwise(gap)
    merged = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(along))
    spans = merged.groupBy(*doc, "template", "span").agg(
        F.count_distinct("place").alias("held"), F.min("diagonal").alias("start"), F.min(F.col("diagonal") + F.col("place")).alias("low"), F.max(F.col("diagonal") + F.col("place")).alias("high"),
        F.max("copies").alias("copies"), *(F.first(c).alias(c) for c in about),
    ).withColumn("part", F.when(F.col("template") >= 0, F.col("held") / F.col("pairs")).otherwise(0.0))
    fits = (F.col("template") >= 0) & (F.col("part") >= F.col("share")) & (F.col("high") - F.col("low") < F.col("pairs") + gap * 4)
    base = fits & F.col("base")
    rows = spans.groupBy(*doc).agg(
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(fits, F.col("label")))), ",").alias("labels"),
        F.round(F.max("part"), 6).alias("score"),
    )
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
