"""License texts by exact set-similarity join with templates.

Base phrases are found where their words stand consecutively. Beyond that, the running words of a
text are cut into overlapping blocks, across line ends, each block is a set of words, and a template
is found in a block that contains at least ``CONTAINMENT`` of the template's distinct words. Blocks
have at least twice the words of the longest template, so that each notice lies in one whole. Lines
longer than half a block are judged by themselves as well.

The join is exact. Words of templates are ordered by how many texts of the whole corpus have them,
rarest first. A block that contains enough of a template must share one of the template's first
words in that order (prefix filter: size - needed + 1 words), must have enough template words at
all (length filter), and enough of them must be left after the first word shared (positional
filter). Blocks meet templates through an inverted index of prefix words; pairs that pass are
verified. Only texts with enough words of some template (a necessary condition) are cut into blocks,
and only the template words of blocks are kept, so rows stay small.

Words are runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased.
Defined results: null and empty texts have no words, no labels and score 0; repeated rows are rows
of their own; ties do not matter, since all labels are reported; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import sized_join, written
from veilframe.llm.spans import let

#: Phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences that license notices consist of.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]
CONTAINMENT = 0.8
#: Texts of more words than this are cut into blocks of so many words, each starting half a block later; more for long templates.
BLOCK_WORDS = 128

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _needed(words: list[str], containment: float) -> int:
    return math.ceil(containment * len(set(words)) - 1e-9)


def _count(words: Column) -> Column:
    """Words of a string of words with a space before and after each."""
    return F.greatest(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long")


def flat_words(text: Column) -> Column:
    """All words in their case, each with a space before and after; one space if there are none."""
    flat = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _BETWEEN, " ")
    return flat


def _blocks(text: Column, vocabulary: Column, size: int) -> Column:
    """Template words of each block of a text."""
    step = size // 2

    def words_of(part: Column) -> Column:
        return F.filter(F.split(F.translate(flat_words(part), _UPPER, _LOWER), " "), lambda w: w != "")

    def cut(words: Column) -> Column:
        return let(words, lambda w: F.when(F.size(w) <= size, F.array(w)).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - step, F.lit(step)), lambda i: F.slice(w, i + 1, F.lit(size)))
        ))

    # A shorter line lies in a block of the running words.
    long_lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), words_of), lambda w: F.size(w) > step)
    blocks = F.concat(cut(words_of(text)), F.flatten(F.transform(long_lines, cut)))
    return F.transform(blocks, lambda b: F.array_intersect(b, vocabulary))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    block_words = max(block_words, 2 * max(len(text.split()) for _, text in templates))
    vocabulary = sorted({w for _, ws in sets for w in ws})
    known = F.lit(vocabulary)
    flat = F.col("flat")
    pattern = r"(?i)(?<= )(?:" + "|".join(PHRASES) + r")(?= )"
    has = flat.rlike(r"(?i) license ")
    found = F.when(has, F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), lambda x: F.translate(x, _UPPER, _LOWER))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(has, F.split(flat, pattern, -1))
    hits = F.array_intersect(known, F.split(F.translate(flat, _UPPER, _LOWER), " "))
    text = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), flat_words(F.col(text_col)).alias("flat"),
    ).withColumns({"found": found, "gaps": gaps, "hits": hits})
    enough = F.lit(False)
    for _, ws in sets:
        enough = enough | (F.size(F.array_intersect("hits", F.lit(ws))) >= _needed(ws, containment))
    last_phrase = F.size(F.split(F.element_at("found", -1), " "))
    some = F.size("found") > 0
    table = written(text.select(
        "id", "row", _count(flat).alias("n_words"), F.size("found").cast("long").alias("n_base"),
        F.when(some, _count(F.element_at("gaps", 1))).alias("first_word"),
        F.when(some, _count(flat) - _count(F.element_at("gaps", -1)) - last_phrase).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: F.element_at(_literal_map(PHRASES), x)))).alias("base_labels"),
        "hits",
        F.when(enough, _blocks(F.col("text"), known, block_words)).alias("blocks"),
    ), "license-words")
    counts = {r["w"]: r["n"] for r in table.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    labels = _joined(table, sets, order, containment)
    both = sized_join(table.drop("hits", "blocks"), labels, "row", "left")
    base_score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return both.select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(base_score, F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _joined(table: DataFrame, sets: list[tuple[str, list[str]]], order: dict[str, int], containment: float) -> DataFrame:
    """Written (row, more, best): labels of contained templates and the best containment per row."""
    spark = table.sparkSession
    index, entries = [], []
    for k, (label, ws) in enumerate(sets):
        ranks = sorted(order[w] for w in ws)
        need = _needed(ws, containment)
        entries.append((k, label, ranks, need))
        index += [(r, k, label, ranks, need, at) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    # The index is as large as the list of templates, which the caller gives.
    prefix = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, words array<int>, need int, at int"))
    rank_of = _literal_map(order)
    blocks = table.where("blocks is not null").select("row", F.posexplode("blocks").alias("block", "words"))
    least = min(e[3] for e in entries)
    blocks = blocks.where(F.size("words") >= least).select("row", "block", F.array_sort(F.transform("words", lambda w: F.element_at(rank_of, w))).alias("own"))
    pairs = blocks.select("row", "block", "own", F.posexplode("own").alias("place", "rank")).join(prefix, "rank")
    # Length and positional filters, then verification.
    left = F.least(F.size("words") - F.col("at"), F.size("own") - F.col("place"))
    pairs = pairs.where((F.size("own") >= F.col("need")) & (left + F.least("at", "place") >= F.col("need")))
    verified = pairs.withColumn("both", F.size(F.array_intersect("own", "words"))).where("both >= need")
    verified = verified.select("row", "label", (F.col("both") / F.size("words")).alias("share"))
    return written(verified.groupBy("row").agg(F.sort_array(F.collect_set("label")).alias("more"), F.max("share").alias("best")), "license-labels")
