"""License scans: phrases, and an exact containment join of template texts with text blocks by prefix filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import ascii_lower, durable, numbered, small, text_of

#: Fixed phrases of the contract, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: A word ends at these: ASCII other than letters and digits (A-Z count as letters only once lower-cased).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Public notices, one sentence each.
TEMPLATES = (
    Template("text:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("text:apache-2.0", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("text:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("text:bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("text:cc-by", "this work is licensed under a creative commons attribution international license"),
    Template("text:mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("text:isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("text:public-domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("text:notice", "released under the mit license"),
    Template("text:spdx-apache", "spdx license identifier apache 2.0"),
    Template("text:spdx-mit", "spdx license identifier mit"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def starts(words: Column, phrase: str) -> Column:
    """Places, from 0, where the words of phrase stand one after another."""
    parts = phrase.split()
    at = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    for k, part in enumerate(parts[1:], 1):
        at = F.filter(at, _follows(words, k, part))
    return at


def _follows(words: Column, k: int, part: str):
    return lambda i: F.coalesce(F.get(words, i + k) == part, F.lit(False))


def phrase_places(docs: DataFrame) -> DataFrame:
    """row, n_words, n_base, first_word, last_word, base (labels) of docs (row, text)."""
    may = "|".join(r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])" + GAP.join(p.split()) + r"(?:$|[\x00-\x2F\x3A-\x60\x7B-\x7F])" for p, _ in PHRASES)
    found = docs.select("doc_id", "row", words_of(F.col("text")).alias("words"), ascii_lower(F.col("text")).rlike(may).alias("may"))
    places = [(label, starts(F.col("words"), phrase)) for phrase, label in PHRASES]
    found = found.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), *(F.when(F.col("may"), p).alias(label) for label, p in places))
    every = F.flatten(F.array(*(F.coalesce(F.col(f"`{label}`"), F.expr("cast(array() as array<int>)")) for _, label in PHRASES)))
    labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(F.col(f"`{label}`")) > 0, label) for _, label in PHRASES))))
    return found.select("doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """row, block, label, score: blocks of docs (row, text) that hold at least threshold of a template's words.

    Blocks are the lines, from 0, and for each template windows of words, -1 - k for the k-th: twice as wide as the template
    and overlapping by half, so that a notice that is wrapped over lines lies whole in one. Templates of one label are told
    apart; a block that several of them match has a row for each. A null text has no blocks; repeated rows (by row) are
    one's own.

    Distinct words of the templates are ordered by the number of documents that have them, rarest first, counted over all
    documents. A document, and then each line of it, meets a template only through the template's prefix, the first
    n - need + 1 words, by a join on the word; a pair goes on if there are words enough (length filter) and if the words
    after the meeting place suffice on both sides (positional filter); what is left is counted out, in lines and in windows.
    """
    spark = docs.sparkSession
    sets = [sorted(set(t.text.split())) for t in templates]
    words = docs.select("row", "text", words_of(F.col("text")).alias("words"))
    vocabulary = sorted(set().union(*sets))
    counts = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # a row for each template word at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, (t, own) in enumerate(zip(templates, sets, strict=True)):
        own = sorted(own, key=rank.__getitem__)
        need = max(1, -int(-threshold * len(own) // 1))
        index += [(w, i, number, t.label, len(own), need, len(t.text.split()), own) for i, w in enumerate(own[: len(own) - need + 1])]
    entry = F.array(*map(F.lit, sorted({x[0] for x in index})))
    table = small(spark.createDataFrame(index, "word string, i int, template long, label string, size int, need int, step int, tokens array<string>"), len(index))

    def met(blocks: DataFrame, *keys: str) -> DataFrame:
        """The pairs of blocks (keys, held: template words in the common order) and templates that pass the filters."""
        pairs = blocks.select(*keys, "held", F.explode(F.array_intersect("held", entry)).alias("word")).join(table, "word")
        j = F.array_position("held", F.col("word")) - 1
        room = F.least(F.col("i"), j) + F.least(F.col("size") - F.col("i"), F.size("held") - j)
        pairs = pairs.filter((F.size("held") >= F.col("need")) & (room >= F.col("need")) & (F.size(F.array_intersect("tokens", "held")) >= F.col("need")))
        return pairs.dropDuplicates([*[k for k in keys if k != "words"], "template"])

    held = lambda w: F.array_intersect(F.array(*map(F.lit, order)), w)
    hot = words.filter(F.arrays_overlap("words", entry))
    lines = hot.select("row", F.posexplode(F.split("text", "\n")).alias("block", "line")).select("row", "block", held(words_of(F.col("line"))).alias("held"))
    in_lines = met(lines, "row", "block").withColumn("n", F.size(F.array_intersect("tokens", "held")))
    whole = met(hot.select("row", "words", held(F.col("words")).alias("held")), "row", "words")
    cut = F.transform(F.sequence(F.lit(0), F.expr("(size(words) - 1) div step").cast("int")), lambda k: F.size(F.array_intersect("tokens", F.slice("words", k * F.col("step") + 1, 2 * F.col("step")))))
    in_windows = whole.select("row", "template", "label", "size", "need", F.posexplode(cut).alias("k", "n")).filter("n >= need").withColumn("block", -1 - F.col("k"))
    columns = ["row", "block", "label", (F.col("n") / F.col("size")).alias("score")]
    return in_lines.select(*columns).unionByName(in_windows.select(*columns))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    labels: the base ones and those of matching templates, distinct, sorted, comma-joined. score: 1 where a phrase
    stands, else the best containment of a matching template, else 0. Null texts count as empty: no words, no labels,
    score 0. Repeated rows keep a row each; an empty table gives an empty one.
    """
    rows = numbered(docs.select("doc_id", text_of().alias("text")), "row")
    best = durable(matches(rows, templates, threshold)).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = phrase_places(rows).join(best, "row", "left")
    none = F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
