"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of words anywhere in the text, whatever its line breaks: as long as the template's notice
and ``SLACK`` of that more. A template matches a block that holds at least ``THRESHOLD`` of the template's distinct words.
The join is exact: the template words are ordered by how many blocks of the whole corpus hold them (rarest first);
a template of n words needing ``need`` of them must share one of its first n - need + 1 words with the block's first
(words shared with the vocabulary) - need + 1 ones (prefix filter); a block needs at least ``need`` vocabulary words
(length filter); at the first shared word, what is left on either side must still reach ``need`` (positional
filter). A window that matches holds one of the same first words, so windows are only laid around those. Survivors are verified on the
whole word sets, and there the words that tell licenses apart count: those that a template must have and those that it must not
(GPL 2 is not GPL 3, and no NonCommercial notice is CC BY). Only DataFrame functions are used; the collected word counts
are bounded by the templates' vocabulary, not by the corpus.

Cases: a null text counts as empty, with 0 words, no labels and score 0; null or repeated doc_ids stay separate rows;
equal rows give equal results; an empty table gives no rows; further columns are ignored. Lower-casing uses ``lower``;
outside A-Z it only maps word characters to word characters, so no count, place or phrase differs.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The phrases that the contract names, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

CC = "This work is licensed under a Creative Commons Attribution"
GNU = "as published by the Free Software Foundation"
GPL = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License {GNU}, either version"

#: Public license notices, as (label, notice, words that must be there, words that must not).
TEMPLATES = [
    ("mit", "Released under the MIT License.", "", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "charge", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", "", ""),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE-2.0", "apache 2", ""),
    ("cc-by", "Licensed under CC BY 4.0.", "", "nc nd sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "", "nd sa"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "", "nc"),
    ("cc-by", f"{CC} 4.0 International License", "attribution", "noncommercial noderivatives noderivs sharealike"),
    ("cc-by-nc", f"{CC}-NonCommercial License", "noncommercial", "noderivatives noderivs sharealike"),
    ("cc-by-nc-nd", f"{CC}-NonCommercial-NoDerivatives 4.0 International License", "noncommercial noderivatives", ""),
    ("cc-by-nc-sa", f"{CC}-NonCommercial-ShareAlike 4.0 International License", "noncommercial sharealike", ""),
    ("cc-by-nd", f"{CC}-NoDerivatives 4.0 International License", "noderivatives", "noncommercial"),
    ("cc-by-sa", f"{CC}-ShareAlike 4.0 International License", "sharealike", "noncommercial"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived", ""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", "gnu 3", "affero lesser"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", "gnu 2", "affero lesser"),
    ("gpl-3", f"{GPL} 3 of the License", "gnu 3", "affero lesser"),
    ("gpl-2", f"{GPL} 2 of the License", "gnu 2", "affero lesser"),
    ("lgpl", f"under the terms of the GNU Lesser General Public License {GNU}", "lesser", ""),
    ("agpl-3", f"under the terms of the GNU Affero General Public License {GNU}, either version 3 of the License", "affero 3", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
]

THRESHOLD = 0.9
#: How much longer than its notice a template's windows are, for inserted words.
SLACK = 0.1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def flat(text: Column) -> Column:
    """The words, lower-cased, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), BREAKS, " "))


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str], list[str], list[str]]]:
    """(label, distinct words, words that must be there, words that must not) of each template."""
    return [(label, sorted(set(re.findall(WORD, notice.lower()))), must.split(), never.split()) for label, notice, must, never in templates]


def window_sizes(templates=TEMPLATES) -> list[int]:
    """The words of each template's windows."""
    return [math.ceil(len(re.findall(WORD, t[1].lower())) * (1 + SLACK)) for t in templates]


def words_in(text: Column, sub: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, sub, F.lit("")))


def phrase_places(padded: Column, phrases=PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels over ' w1 w2 ... wn '."""
    blank = F.lit(" ")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        around = f" {phrase} "
        there = F.contains(padded, F.lit(around))
        counts.append(F.when(there, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        before = F.substring_index(padded, around, 1)
        after = F.substring_index(padded, around, -1)
        firsts.append(F.when(there, words_in(before, blank)))
        total = words_in(padded, blank) - 1
        lasts.append(F.when(there, total - words_in(after, blank) - len(phrase.split()) + 1 - 1))
        labels.append(F.when(there, F.lit(label)))
    n = counts[0]
    for c in counts[1:]:
        n = n + c
    return {
        "n_base": n.cast("long"),
        "first_word": F.array_min(F.array(*firsts)).cast("long"),
        "last_word": F.array_max(F.array(*lasts)).cast("long"),
        "base_list": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def surroundings(words: Column, heads: list[str], longest: int) -> Column:
    """array<struct<word, before, around>>: each head with up to ``longest`` - 1 words on either side, ``before`` of them before it."""
    one = F.transform(words, lambda w, i: F.when(F.array_contains(F.lit(heads), w), F.struct(
        w.alias("word"), F.least(i, F.lit(longest - 1)).alias("before"),
        F.slice(words, F.greatest(F.lit(1), i - longest + 2), F.least(i, F.lit(longest - 1)) + longest).alias("around"))))
    return F.when(F.arrays_overlap(words, F.lit(heads)), F.array_compact(one))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    spark = documents.sparkSession
    sets = template_words(templates)
    vocabulary = sorted({w for _, *lists in sets for words in lists for w in words})
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def tokens(block: Column) -> Column:
        return F.split(F.regexp_replace(F.lower(block), BREAKS, " "), " ")

    held = rows.select(F.explode(F.split("text", "\n")).alias("block")).select(
        F.explode(F.array_intersect(F.lit(vocabulary), tokens(F.col("block")))).alias("word"))
    counted = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}

    plans = []
    for (label, words, must, never), size in zip(sets, window_sizes(templates)):
        ordered = sorted(words, key=place.get)
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        plans += [(label, ordered, need, size, must, never, w, i) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    heads = sorted({p[6] for p in plans})
    # the templates' prefixes: fixed by TEMPLATES, a few hundred rows at most
    prefixes = spark.createDataFrame(plans, "label string, template array<string>, need int, length int, must array<string>, never array<string>, word string, t_place int")

    padded = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))
    base = rows.select("doc_id", "text", flat(F.col("text")).alias("flat")).select(
        "doc_id",
        F.when(F.col("flat") == "", 0).otherwise(words_in(F.col("flat"), F.lit(" ")) + 1).cast("long").alias("n_words"),
        *[c.alias(k) for k, c in phrase_places(padded, phrases).items()],
        F.filter(F.split("text", "\n"), lambda b: F.arrays_overlap(tokens(b), F.lit(heads))).alias("blocks"),
        F.split("flat", " ").alias("all_words"),
    ).withColumn("surroundings", surroundings(F.col("all_words"), heads, max(window_sizes(templates)))).drop("all_words").withColumn("row", F.monotonically_increasing_id())
    base = cut(base)

    blocks = base.select("row", F.explode("blocks").alias("block")).select(
        "row", F.array_intersect(F.lit(order), tokens(F.col("block"))).alias("words"))
    first = blocks.select("row", "words", F.posexplode("words").alias("b_place", "word"))
    met = first.join(F.broadcast(prefixes), "word").where(
        (F.size("words") >= F.col("need"))
        & (F.col("b_place") <= F.size("words") - F.col("need"))
        & (F.least(F.size("words") - F.col("b_place"), F.size("template") - F.col("t_place")) >= F.col("need")))
    telling = lambda held: (F.size(F.array_except("must", held)) == 0) & ~F.arrays_overlap("never", held)
    shared = F.when(telling(F.col("words")), F.size(F.array_intersect("words", "template"))).otherwise(0)
    in_lines = met.where(shared >= F.col("need")).select("row", "label", (shared / F.size("template")).alias("part"))

    # of the words around a head those that a window of the template's length with this head can hold
    near = base.select("row", F.explode("surroundings").alias("s")).select("row", "s.word", "s.before", "s.around").join(F.broadcast(prefixes), "word")
    begin = F.greatest(F.lit(0), F.col("before") - F.col("length") + 1)
    near = near.select("row", "label", "template", "need", "length", "must", "never", F.slice(
        "around", begin + 1, F.col("before") - begin + F.col("length")).alias("around")).where(
        F.size(F.array_intersect("around", "template")) >= F.col("need"))
    window = lambda i: F.slice("around", i, F.col("length"))
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("around") - F.col("length") + 1)), lambda i: F.when(
        telling(window(i)), F.size(F.array_intersect(window(i), F.col("template")))).otherwise(0)))
    in_windows = near.select("row", "label", "need", "template", most.alias("most")).where(F.col("most") >= F.col("need")).select(
        "row", "label", (F.col("most") / F.size("template")).alias("part"))
    found = in_lines.unionByName(in_windows).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("part").alias("best"))

    labels = F.array_sort(F.array_union("base_list", F.coalesce(F.col("more"), F.array().cast("array<string>"))))
    return base.drop("blocks", "surroundings").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_list").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("best"), F.lit(0.0))).alias("score"))


def oracle() -> str:
    """The same by brute force: every line against every template."""
    listed = lambda words: f"CAST({words!r} AS VARCHAR[])"
    values = ", ".join(f"('{label}', {words!r}, {max(1, math.ceil(THRESHOLD * len(words) - 1e-9))}, {listed(must)}, {listed(never)})" for label, words, must, never in template_words())
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spots = []
    for phrase in PHRASES:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(words, 1))
        spots.append(f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {test})")
    labels = list(PHRASES.values())
    return f"""
WITH t(label, words, need, must, never) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{low}') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{pattern}') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, {', '.join(f'{s} AS p{i}' for i, s in enumerate(spots))} FROM w),
b AS (SELECT r, unnest(string_split(text, chr(10))) AS block FROM d),
bw AS (SELECT r, list_distinct(regexp_extract_all(block, '{pattern}')) AS words FROM b),
m AS (SELECT r, label, CAST(len(list_intersect(bw.words, t.words)) AS DOUBLE) / len(t.words) AS s
      FROM bw JOIN t ON len(list_intersect(bw.words, t.words)) >= need AND list_has_all(bw.words, must) AND NOT list_has_any(bw.words, never)),
f AS (SELECT r, list(DISTINCT label) AS more, max(s) AS best FROM m GROUP BY r),
q AS (SELECT r, doc_id, n_words, list_concat({', '.join(f'p{i}' for i in range(len(spots)))}) AS spots,
      list_concat({', '.join(f"CASE WHEN len(p{i}) > 0 THEN ['{label}'] ELSE CAST([] AS VARCHAR[]) END" for i, label in enumerate(labels))}) AS base
      FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base,
       CAST(list_min(spots) AS BIGINT) AS first_word, CAST(list_max(spots) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, CAST([] AS VARCHAR[]))))), ','), '') AS labels,
       CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM q LEFT JOIN f USING (r)
"""
