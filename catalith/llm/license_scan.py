"""License scan by diagonal voting, in DataFrame functions only.

Every text becomes its words; the hashes of all its rolling word k-grams meet, by a Spark join, the places of the
same k-grams in license notices. Matches on one diagonal (place in the text less place in the notice) vote for
one copy of the notice; diagonals at most MAX_SHIFT apart, where words were added or lost, are merged to a span.
A span is verified by the words that its votes cover: MIN_COVER of the notice's k-grams occur on it, each at another
place, and among them all of the notice's deciding words, which tell it from its siblings (a version, "noncommercial",
"gnu general" without "lesser" between). Words that decide nothing may be lost or changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels and phrases that are searched word by word.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Labels and notices, by the first words of public licenses and their usual short forms; the deciding words, three or more in a row, are in brackets.
NOTICES = [
    ("mit", "released under [the mit license]"),
    ("mit", "licensed under [the mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the [apache license version 2] 0"),
    ("apache-2", "you may obtain a copy of the license at http www [apache org licenses license 2] 0"),
    ("apache-1.1", "licensed under the [apache license version 1 1]"),
    ("gpl-2", "this work is licensed under the [gnu general public license version 2]"),
    ("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    ("lgpl-2.1", "this work is licensed under the [gnu lesser general public license version 2 1]"),
    ("lgpl-3", "this work is licensed under the [gnu lesser general public license version 3]"),
    ("agpl-3", "this work is licensed under the [gnu affero general public license version 3]"),
    ("gpl", "you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the [gnu affero general public license] as published by the free software foundation"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("mpl-1.1", "the contents of this file are subject to the [mozilla public license version 1 1]"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2] 0"),
    ("epl-2", "made available under the terms of the [eclipse public license 2] 0"),
    ("boost-1", "distributed under the [boost software license version 1] 0"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
    ("cc0", "to the extent possible under law the author has dedicated [all copyright and related and neighboring rights] to the public domain"),
    ("cc-by", "licensed under [cc by 4] 0"),
    ("cc-by-sa", "licensed under [cc by sa 4] 0"),
    ("cc-by-nd", "licensed under [cc by nd 4] 0"),
    ("cc-by-nc", "licensed under [cc by nc 4] 0"),
    ("cc-by-nc-sa", "licensed under [cc by nc sa 4] 0"),
    ("cc-by-nc-nd", "licensed under [cc by nc nd 4] 0"),
    ("cc-by", "this work is licensed under a creative [commons attribution 4] 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative [commons attribution sharealike 4] 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative [commons attribution noderivatives 4] 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative [commons attribution noncommercial 4] 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative [commons attribution noncommercial sharealike 4] 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative [commons attribution noncommercial noderivatives 4] 0 international license"),
]
GRAM = 3
MAX_SHIFT = 2
MIN_COVER = 0.6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text with one space before and after each: " w w ", or " " without words."""
    words = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _grams(words: Column, k: int) -> Column:
    """The hash of each k consecutive words, in order."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def deciding(notice: str, k: int) -> list[int]:
    """The places of the notice's k-grams that lie in brackets."""
    marked, places, open_ = notice.split(), [], False
    for i, word in enumerate(marked):
        open_ |= word.startswith("[")
        if open_ and not any(w.endswith("]") for w in marked[i : i + k - 1]) and i + k <= len(marked):
            places.append(i)
        open_ &= not word.endswith("]")
    return places


def templates(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES, k: int = GRAM) -> DataFrame:
    """(notice, label, words, deciding): a row for each notice."""
    rows = [(i, label, text, deciding(text, k)) for i, (label, text) in enumerate(notices)]
    table = spark.createDataFrame(rows, "notice int, label string, text string, deciding array<int>")
    return table.select("notice", "label", F.split(F.trim(spaced(F.col("text"))), " ").alias("words"), "deciding")


def template_grams(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES, k: int = GRAM) -> DataFrame:
    """(gram, notice, place): a row for each k-gram of the notices; it doesn't grow with the data."""
    return templates(spark, notices, k).select("notice", F.posexplode(_grams(F.col("words"), k)).alias("place", "gram"))


def found_notices(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, k: int = GRAM) -> DataFrame:
    """Verified spans: doc_id, th (hash of the text), label, notice, cover, start and end (words)."""
    grams = F.broadcast(template_grams(docs.sparkSession, notices, k))  # some hundred rows, fixed above
    known = F.broadcast(templates(docs.sparkSession, notices, k).select("notice", "label", (F.size("words") - k + 1).alias("size"), "deciding"))
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split(F.trim(spaced(F.col("text"))), " ").alias("words"))
    placed = words.select("doc_id", "th", F.posexplode(_grams(F.col("words"), k)).alias("pos", "gram"))
    by = ["doc_id", "th", "notice"]
    votes = placed.join(grams, "gram").withColumn("diagonal", F.col("pos") - F.col("place"))
    lines = votes.groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    in_order = Window.partitionBy(*by).orderBy("diagonal")  # diagonals of one text and notice
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_order) > MAX_SHIFT).cast("int"), F.lit(0))
    merged = lines.withColumn("_new", apart).withColumn("_set", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*by, "_set").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("lo").alias("start"), (F.max("hi") + k).alias("end"))
    spans = spans.join(known, "notice").withColumn("cover", F.size("places") / F.col("size"))
    verified = (F.col("cover") >= MIN_COVER) & (F.size(F.array_except("deciding", "places")) == 0)
    return spans.where(verified).select("doc_id", "th", "label", "notice", "cover", "start", "end")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans of each document.

    Words: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII. n_base: places where a phrase's
    words stand one after another; first_word, last_word: the smallest and largest of them (null without one).
    labels: those of the phrases and of verified notices; notices that tie each give their label. score: the best
    cover of a notice, or 1 with a phrase. Null or empty text: no words, no labels (empty strings), score 0. Null doc_id
    and repeated rows are scanned like any other. A text of any length is scanned whole. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s, n = F.col("_s"), _spaces(F.col("_s")) - 1
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), spaced(F.col("text")).alias("_s"))
    each = {label: f" {phrase} " for label, phrase in PHRASES.items()}
    has = {label: s.contains(p) for label, p in each.items()}
    counts = [F.when(has[k], F.regexp_count(s, F.lit(f" {PHRASES[k]}(?= )"))).otherwise(0) for k in each]
    first = [F.when(has[k], _spaces(F.substring_index(s, p, 1))) for k, p in each.items()]
    last = [F.when(has[k], n - _spaces(F.substring_index(s, p, -1)) - len(PHRASES[k].split())) for k, p in each.items()]
    base = base.select(
        "doc_id",
        "th",
        n.alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*(F.when(has[k], F.lit(k)) for k in each)))).alias("base"),
    )
    spans = found_notices(docs)
    more = spans.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"), F.count("*").alias("n_spans"))
    more = more.select(F.col("doc_id").alias("_of"), F.col("th").alias("_th"), "more", "cover", "n_spans")
    joined = base.join(more, base["doc_id"].eqNullSafe(more["_of"]) & (base["th"] == more["_th"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
