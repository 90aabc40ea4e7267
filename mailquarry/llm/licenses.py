"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a line of a text or a run of neighbouring lines, as wrapped notices stand in; no line of a run is without words.
A notice is one of ``NOTICES``; both are sets of words. The lines of a run between its first and its last one must
not have more words than the notice, divided by ``THRESHOLD``. A notice stands in a block if the block has at least ``THRESHOLD`` of its words. Only words of notices matter, so a block is its words among
those. The words are ordered by how many blocks have them, rare ones first, over all blocks. Of a notice of n words of
which k are needed, one of the first n - k + 1 must be in the block (prefix filter); the block must have k
words of notices at all (length filter); and from the first common word on, both must have enough words left to reach
k (positional filter). What remains is compared word by word. Everything is DataFrame operations.

The contract's base phrases are found as consecutive words of the whole text. Words are runs of ASCII letters, digits and
all characters beyond ASCII, with A-Z in lower case.

Cases: a null text has no words. A document without a license has empty labels, null positions and score 0. Blocks
and notices with the same words are compared like any other. Repeated rows are answered as often as they occur.
Extra columns are not read. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import same_row
from mailquarry.sinks.facts import staged

THRESHOLD = 0.9
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices as they are commonly written, and their labels. Fixed values.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License. See the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "Copyright. All rights reserved."),
)
#: Everything in ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEWLINE_KEPT = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. The Kelvin sign is the one other character whose lower case is an ASCII letter
    alone; it is put aside as another letter."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def notices_table(spark, notices=NOTICES) -> DataFrame:
    """(notice, label, words) with distinct words."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(notices)], "notice int, label string, text string")
    words = F.filter(F.split(F.regexp_replace(lowered(F.col("text")), GAP, " "), " "), lambda w: w != "")
    return rows.select("notice", "label", F.array_distinct(words).alias("words"), F.size(words).alias("length"))


def blocks_of(plain: Column, vocabulary: Column, least: int, most_inside: int) -> Column:
    """Array of (inside, words): the words of ``vocabulary`` in each line and in the runs of lines that start there and have at most
    ``most_inside`` words between their first and last line; inside is the number of these. Only blocks with ``least`` words."""
    def measured(line: Column) -> Column:
        bare = F.trim(line)
        count = F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)
        return F.struct(F.array_intersect(F.split(line, " "), vocabulary).alias("words"), count.cast("int").alias("n"))

    def block(inside: Column, words: Column) -> Column:
        return F.struct(inside.cast("int").alias("inside"), words.alias("words"))

    def state(open_: Column, inside: Column, last: Column, words: Column, found: Column) -> Column:
        return F.struct(open_.alias("open"), inside.cast("int").alias("inside"), last.cast("int").alias("last"), words.alias("words"), found.alias("found"))

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def longer(now: Column, line: Column) -> Column:
        def with_words(words: Column) -> Column:
            inside = now["inside"] + now["last"]
            new = (F.size(words) >= least) & (F.size(words) > F.size(now["words"]))  # without a new word the shorter run has all
            found = F.when(new, F.concat(now["found"], F.array(block(inside, words)))).otherwise(now["found"])
            return state(F.lit(True), inside, line["n"], words, found)

        fits = now["open"] & (line["n"] > 0) & (now["inside"] + now["last"] <= most_inside)
        closed = state(F.lit(False), now["inside"], now["last"], now["words"], now["found"])
        return F.when(fits, bound(F.array_union(now["words"], line["words"]), with_words)).otherwise(closed)

    def runs(lines: Column) -> Column:
        def from_line(own: Column, at: Column) -> Column:
            first = F.when(F.size(own["words"]) >= least, F.array(block(F.lit(0), own["words"]))).otherwise(none)
            start = state(own["n"] > 0, F.lit(0), F.lit(0), own["words"], first)
            return F.aggregate(F.slice(lines, at + 2, F.lit(most_inside + 2)), start, longer, lambda end: end["found"])

        return F.flatten(F.transform(lines, from_line))

    none = F.array().cast("array<struct<inside:int,words:array<string>>>")
    return bound(F.transform(F.split(plain, "\n"), measured), runs)


def matches(blocks: DataFrame, notices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(block columns, label, containment): all pairs of a block (with the set ``words``, named by ``block``) and a notice
    (notice, label, words) with containment of at least ``threshold``."""
    frequency = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = notices.select(F.explode("words").alias("word")).distinct().join(frequency, "word", "left")
    # as many as the notices have words, however large the corpus
    order = F.lit([r["word"] for r in vocabulary.orderBy(F.coalesce("n", F.lit(0)), "word").collect()])

    def ranked(words: Column) -> Column:
        return F.array_sort(F.transform(words, lambda w: F.array_position(order, w).cast("int")))

    needed = F.ceil(F.size("ranks") * F.lit(threshold) - 1e-9).cast("int")
    notices = notices.select("notice", "label", ranked(F.col("words")).alias("ranks"))
    notices = notices.where(F.size("ranks") > 0).withColumn("needed", needed)
    prefixes = notices.select("notice", "label", F.col("ranks").alias("own"), "needed", F.posexplode(F.slice("ranks", 1, F.size("ranks") - F.col("needed") + 1)).alias("own_at", "rank"))
    blocks = blocks.select("block", ranked(F.col("words")).alias("ranks"))
    tokens = blocks.select("block", "ranks", F.posexplode("ranks").alias("at", "rank"))
    pairs = tokens.join(prefixes, "rank").where(F.size("ranks") >= F.col("needed"))
    pairs = pairs.where(F.least(F.size("own") - F.col("own_at"), F.size("ranks") - F.col("at")) + F.least("own_at", "at") >= F.col("needed"))
    common = F.size(F.array_intersect("own", "ranks"))
    pairs = pairs.select("block", "notice", "label", common.alias("common"), "needed", F.size("own").alias("size")).where(F.col("common") >= F.col("needed"))
    return pairs.groupBy("block", "notice").agg(F.min("label").alias("label"), F.max(F.col("common") / F.col("size")).alias("containment"))


def phrase_places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first word, last word) of a phrase in text whose every word has a space on both sides."""
    # words are two spaces apart, so neighbouring places don't share one
    find = F.lit(" " + phrase.replace(" ", "  ") + " ")
    places = ((F.length(spaced) - F.length(F.replace(spaced, find, F.lit("")))) / F.length(find)).cast("long")
    before = F.call_function("substring_index", spaced, find, F.lit(1))
    up_to_last = F.substring(spaced, F.lit(1), F.length(spaced) - F.length(F.call_function("substring_index", spaced, find, F.lit(-1))) - F.length(find))

    def words(text: Column) -> Column:
        return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")

    return places, F.when(places > 0, words(before)), F.when(places > 0, words(up_to_last))


def scanned(docs: DataFrame, notices: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``."""
    spark = docs.sparkSession
    notices = staged(notices if notices is not None else notices_table(spark), "llm-notices")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.regexp_replace(lowered(text), NEWLINE_KEPT, " ").alias("plain"))
    # one space on both sides of each word: " one  two "; runs of gaps are one space, line ends apart
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace("plain", " ?\n[ \n]*", " "), " ", "  ")), F.lit(" "))
    rows = rows.withColumn("spaced", spaced)
    found = {label: phrase_places(F.col("spaced"), phrase) for phrase, label in PHRASES.items()}
    n_base = sum((x[0] for x in found.values()), F.lit(0))
    base = F.filter(F.array(*[F.when(x[0] > 0, F.lit(label)) for label, x in found.items()]), lambda x: x.isNotNull())
    n_words = F.when(F.trim("spaced") == "", F.lit(0)).otherwise((F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit("")))) / 2)
    known = notices.select(F.explode("words").alias("w")).agg(F.collect_set("w").alias("words")).first()["words"]  # of the notices only
    length = F.col("length") if "length" in notices.columns else F.size("words")
    limits = notices.select("notice", F.floor(length / F.lit(threshold) + 1e-9).cast("int").alias("most"))
    least = notices.agg(F.min(F.ceil(F.size("words") * F.lit(threshold) - 1e-9))).first()[0] or 1
    most_inside = limits.agg(F.max("most")).first()[0] or 0
    vocabulary = F.lit(sorted(known)) if known else F.array().cast("array<string>")
    blocks = blocks_of(F.col("plain"), vocabulary, least, most_inside)
    rows = rows.select(
        "doc_id", "text_hash", n_words.cast("long").alias("n_words"), n_base.alias("n_base"),
        F.least(*[x[1] for x in found.values()]).alias("first_word"), F.greatest(*[x[2] for x in found.values()]).alias("last_word"),
        base.alias("base"), blocks.alias("blocks"))
    rows = staged(rows, "llm-blocks")
    each = rows.select("doc_id", "text_hash", F.posexplode("blocks").alias("at", "run"))
    each = each.select(F.struct("doc_id", "text_hash", "at", "run.inside").alias("block"), "run.words")
    found_in = matches(each, notices, threshold).join(F.broadcast(limits), "notice").where(F.col("block.inside") <= F.col("most"))
    hits = found_in.groupBy(F.col("block.doc_id").alias("_id"), F.col("block.text_hash").alias("_hash")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    hits = staged(hits, "llm-licenses")
    rows = rows.drop("blocks").join(hits, same_row(F.col("doc_id"), F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<string>")
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("containment", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none)))), ",").alias("labels"), score.alias("score"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL of the query over documents; every block is compared with every notice."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    notices = ", ".join(f"({i}, {_sql_text(label)}, {_sql_text(text.lower())})" for i, (label, text) in enumerate(NOTICES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, {_sql_text(label)} AS label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) "
        f"WHERE w[i:i + {len(phrase.split()) - 1}] = [{', '.join(map(_sql_text, phrase.split()))}]" for phrase, label in PHRASES.items())
    return f"""
WITH low AS (SELECT doc_id, {lower} AS t FROM documents),
words AS (SELECT doc_id, {words.format('t')} AS w FROM low),
places AS ({phrases}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
notices AS (SELECT n, label, list_distinct({words.format('t')}) AS w FROM (VALUES {notices}) v(n, label, t)),
blocks AS (SELECT doc_id, list_distinct({words.format('line')}) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM low)),
pairs AS (
  SELECT doc_id, label, len(list_intersect(w, b)) AS common, len(w) AS size FROM blocks, notices
  WHERE len(list_intersect(w, b)) >= ceil(len(w) * CAST({THRESHOLD} AS DOUBLE) - 1e-9)),
hits AS (SELECT doc_id, list(DISTINCT label) AS labels, max(common / size) AS containment FROM pairs GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hits.labels, [])))), ','), '') AS labels,
       greatest(CASE WHEN base.doc_id IS NULL THEN 0.0 ELSE 1.0 END, coalesce(containment, 0.0)) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN hits USING (doc_id)"""
