"""License scans: license phrases, and text blocks that contain a license notice by set similarity.

Base labels come from phrases of consecutive words. The method's labels come from an exact
set-similarity join of text blocks with notice templates: a block matches if it holds at least
`threshold` of a template's distinct words. Blocks are lines, and, so that line breaks do not matter,
all windows of WIDTH times a template's length in consecutive words of the text; they are looked
at in texts that as a whole hold enough of the template's words. For lines, words are ordered by how many blocks of the
whole corpus hold them, rarest first; then only a template's first words (its prefix) need be
looked up, as a match must share one of them, a block needs enough words (length filter), and
at a shared word enough words must be left on both sides (positional filter). Survivors are verified.

DataFrame operations only. Words are runs of letters, digits and non-ASCII characters with A-Z in
lower case. A null text is empty and has no words. Rows of equal or null doc_id are scanned one by one.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words of a window for each word of a template.
WIDTH = 2

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices, one line each, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def all_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split()


def template_words(text: str) -> list[str]:
    """Distinct words in order of appearance."""
    return list(dict.fromkeys(all_words(text)))


def words(text: Column) -> Column:
    parts = F.split(F.translate(text, UPPER, LOWER), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words, by one split at what is between them (Spark's count of a pattern's matches takes ten times as long)."""
    return F.size(F.array_remove(F.split(text, NOT_WORD), "")).cast("long")


def may_hold(text: Column, vocabulary: set[str]) -> Column:
    """Whether a lower-case word of the vocabulary stands in the text in any ASCII case, within a longer word too.

    By search for plain strings: a pattern of alternatives is tried at every place of a text. lower() changes more than
    A-Z, but keeps each of these letters, so it serves for ASCII words.
    """
    lowered = {True: F.lower(text), False: F.translate(text, UPPER, LOWER)}
    return reduce(or_, (lowered[w.isascii()].contains(w) for w in sorted(vocabulary, key=lambda w: (len(w), w))))


def least_shared(n: int, threshold: float) -> int:
    return max(1, math.ceil(n * threshold - 1e-9))


def _places(phrase: str) -> Column:
    """Where the phrase's words stand in the column `words`."""
    parts = phrase.split()
    last = F.size("words") - len(parts)
    here = lambda i: F.get(F.col("words"), i) == parts[0]

    def at(i):
        same = here(i)
        for j, part in enumerate(parts[1:], 1):
            same = same & (F.get(F.col("words"), i + j) == part)
        return same

    return F.when((last >= 0) & F.array_contains("words", parts[0]), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))


def _most_shared(template: list[str], length: int, need: int) -> Column:
    """The most of the template's words in a window of `length` of `words`, null if all of them hold less than needed.

    A best window can start at a word of the template.
    """
    own = _strings(template)
    starts = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(own, w), i)), lambda i: i.isNotNull())
    shared = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i + 1, length), own))))
    return F.when(F.size(F.array_intersect("held", own)) >= need, shared)


def _lines(docs: DataFrame) -> DataFrame:
    """Each text's lines."""
    return docs.select("*", F.explode(F.split("t", "\n")).alias("line"))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def rank_words(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Places of the templates' words by the number of blocks of all texts that hold them, rarest first."""
    blocks = _lines(docs.select(F.coalesce("text", F.lit("")).alias("t")))
    held = blocks.select(F.explode(F.array_intersect(F.split(F.translate("line", UPPER, LOWER), NOT_WORD), _strings(vocabulary))).alias("w"))
    counts = {r["w"]: r["c"] for r in held.groupBy("w").agg(F.count("*").alias("c")).collect()}  # at most the vocabulary
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's words found in one block, if at least threshold, and 1 with a phrase.
    """
    sets = [(label, template_words(text)) for label, text in templates]
    lengths = [WIDTH * len(all_words(text)) for (_, ws), (_, text) in zip(sets, templates, strict=True) if ws]
    sets = [(label, ws) for label, ws in sets if ws]
    rank = rank_words(docs, sorted({w for _, ws in sets for w in ws}))
    index, prefix = [], {"license"}
    for i, (_, ws) in enumerate(sets):
        ordered = sorted(rank[w] for w in ws)
        need = least_shared(len(ws), threshold)
        first = ordered[: len(ws) - need + 1]
        prefix |= {w for w in ws if rank[w] in first}
        index += [(i, r, at, len(ws), need) for at, r in enumerate(first)]
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # a text without any prefix word matches no template and holds no phrase
    marked = base.withColumn("busy", may_hold(F.col("t"), prefix))
    none = F.lit(None).cast("long")
    plain = marked.filter(~F.col("busy")).select(
        "doc_id", count_words(F.col("t")).alias("n_words"), F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )
    found = {label: _places(phrase) for phrase, label in PHRASES.items()}
    busy = marked.filter("busy").select(F.monotonically_increasing_id().alias("row"), "doc_id", "t", words(F.col("t")).alias("words"))
    busy = busy.withColumn("held", F.array_intersect("words", _strings(sorted(rank))))
    windows = (
        F.struct(F.lit(label).alias("label"), (_most_shared(ws, length, least_shared(len(ws), threshold)) / len(ws)).alias("part"), F.lit(least_shared(len(ws), threshold) / len(ws)).alias("need"))
        for (label, ws), length in zip(sets, lengths, strict=True)
    )
    wide = F.filter(F.array(*windows), lambda m: m["part"] >= m["need"]) if sets else F.array().cast("array<struct<label:string,part:double,need:double>>")
    lines = F.when(F.arrays_overlap("words", _strings(sorted(prefix))), F.col("t")).otherwise("")  # none match without a whole prefix word
    busy = busy.select("row", "doc_id", lines.alias("t"), wide.alias("wide"), F.size("words").cast("long").alias("n_words"), F.struct(*(places.alias(label) for label, places in found.items())).alias("at"))
    every = F.concat(*(F.col(f"at.{label}") for label in found))
    labels = F.concat(*(F.when(F.size(f"at.{label}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label in found))
    busy = busy.select("row", "doc_id", "t", "wide", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    ranks = F.create_map(*(x for w, r in rank.items() for x in (F.lit(w), F.lit(r))))
    held = F.array_intersect(F.split(F.translate("line", UPPER, LOWER), NOT_WORD), _strings(sorted(rank)))
    blocks = _lines(busy).select("row", "doc_id", "wide", "n_words", "n_base", "first_word", "last_word", "base", F.array_sort(F.transform(held, lambda w: F.element_at(ranks, w))).alias("ranks"))
    matches = F.array().cast("array<struct<label:string,score:double>>")
    entry = lambda e: F.struct(*(F.lit(x).alias(n) for x, n in zip(e, ("i", "rank", "at", "size", "need"), strict=True)))
    starts = F.array(*map(entry, index))

    def passes(e):
        place = F.array_position(F.col("ranks"), e["rank"]) - 1  # in the block's words, -1: not there
        enough = F.size("ranks") >= e["need"]
        left = F.least(F.size("ranks") - place - 1, e["size"] - e["at"] - 1) + 1
        # words shared before this place were entries of their own, so what is left must suffice from the first shared one on
        return enough & (place >= 0) & (left + e["at"] >= e["need"])

    candidates = F.array_distinct(F.transform(F.filter(starts, passes), lambda e: e["i"]))
    blocks = blocks.withColumn("candidates", candidates)
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*(F.lit(rank[w]) for w in ws)).alias("words"), F.lit(float(least_shared(len(ws), threshold))).alias("need")) for label, ws in sets))
    verified = F.transform("candidates", lambda i: F.struct(F.get(table, i)["label"].alias("label"), F.size(F.array_intersect(F.col("ranks"), F.get(table, i)["words"])).alias("shared"), F.size(F.get(table, i)["words"]).alias("size"), F.get(table, i)["need"].alias("need")))
    matches = F.filter(verified, lambda m: m["shared"] >= m["need"])
    blocks = blocks.withColumn("matches", matches)
    one = blocks.select("row", "doc_id", "wide", "n_words", "n_base", "first_word", "last_word", "base", F.transform("matches", lambda m: m["label"]).alias("more"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["shared"] / m["size"])), F.lit(0.0)).alias("part"))
    per_doc = one.groupBy("row", "doc_id", "wide", "n_words", "n_base", "first_word", "last_word", "base").agg(
        F.array_distinct(F.flatten(F.collect_set("more"))).alias("more"), F.max("part").alias("part")
    )
    per_doc = per_doc.withColumn("more", F.array_union("more", F.transform("wide", lambda m: m["label"])))
    per_doc = per_doc.withColumn("part", F.greatest("part", F.array_max(F.transform("wide", lambda m: m["part"]))))
    full = per_doc.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("part")).alias("score"),
    )
    return plain.union(full)


def sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The result of lines alone in DuckDB's SQL, by comparing every line with every template; notices wrapped over lines are not in it."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    quoted = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
    rows = ", ".join(f"('{label}', {quoted(template_words(text))}, {least_shared(len(template_words(text)), threshold)})" for label, text in templates)
    places = [
        f"list_transform(list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {j + 1}] = {chr(39)}{p}{chr(39)}' for j, p in enumerate(phrase.split()))}), lambda i: {{'label': '{label}', 'i': i}})"
        for phrase, label in PHRASES.items()
    ]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {word}) AS w FROM d),
b AS (SELECT r, doc_id, len(w) AS n_words, {' || '.join(places)} AS p FROM w),
templates(label, words, need) AS (VALUES {rows}),
lines AS (SELECT DISTINCT r, list_distinct(regexp_extract_all(line, {word})) AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT r, list(DISTINCT label) AS more, max(len(list_intersect(ws, words)) / len(words)) AS part
      FROM lines JOIN templates ON len(list_intersect(ws, words)) >= need GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(p, lambda x: x.i)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.i)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label) || coalesce(more, []))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(part, 0.0) END AS score
FROM b LEFT JOIN m USING (r)"""
