"""Licence notices in texts, by a positional index of the notices' rarest words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. One
pass counts in how many texts each template word occurs. The index has the postings
(template, place) of each template's ``anchors`` rarest words by that count. A
second pass looks up those of a text's words that are in it, which are its licence
words of the highest inverse document frequency, whatever template they are of. The
text place less the template place is a vote for where the template begins, weighed
by inverse document frequency; votes are intersected by sorting them by template and
beginning. Every beginning counts that has ``threshold`` of all weight and the
template's key phrase where it must stand.

Everything is a column expression: no row leaves its task, and the index is a
constant of as many entries as the templates have anchors.

Edge cases: null and empty texts have no words; texts of any length are read whole;
equal words count equally, ties in rarity go by the word; repeated rows are scanned
each; without any texts the counts are zero, the index still stands, and there are no
rows. Columns named like the added ones (``n_words, base, matches``) are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANCHORS, THRESHOLD = 8, 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str  #: as words, lower case, one blank between
    phrase: str  #: part of the text that must be there as it is


# Opening words of public licence notices.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge to any person obtaining a copy"),
    Template("mit", "released under the mit license", "under the mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
)

#: Phrases whose every place is counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _quoted(words: list[str] | set[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def words_column(text: F.Column) -> F.Column:
    """The words as they are written; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many texts each word of a fixed, small ``vocabulary`` occurs; the result has no more rows than that."""
    listed = F.array(*(F.lit(w) for w in sorted(vocabulary)))
    seen = F.array_intersect(F.transform(words_column(F.col("text")), lambda w: F.lower(w)), listed)
    counted = docs.select(F.explode(seen).alias("w")).groupBy("w").count()
    return {r.w: r["count"] for r in counted.collect()}


def license_matches(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, anchors: int = ANCHORS, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` and ``n_words``, ``base`` (array of ``at, n, label``) and ``matches`` (``label, score, at``)."""
    vocabulary = {w for t in templates for w in t.text.split()}
    df = document_frequencies(docs, vocabulary)
    n_docs = max(1, docs.count())
    idf = {w: math.log1p(n_docs / (1 + df.get(w, 0))) for w in vocabulary}

    index = []
    for t in templates:
        places: dict[str, list[int]] = {}
        for i, w in enumerate(t.text.split()):
            places.setdefault(w, []).append(i)
        rare = sorted(places, key=lambda w: (-idf[w], w))[:anchors]
        index.append([(w, i, idf[w]) for w in rare for i in places[w]])

    ends = {p.split()[-1] for p in base}
    looked_up = ends | {w for entries in index for w, *_ in entries}
    hit = f"CASE WHEN lower(w) IN ({_quoted(looked_up)}) AND octet_length(w) = length(w) THEN struct(i AS i, lower(w) AS w) END"
    found = (
        docs.withColumn("__words", words_column(F.col("text")))
        .withColumn("n_words", F.size("__words").cast("bigint"))
        .withColumn("__hits", F.expr(f"filter(transform(__words, (w, i) -> {hit}), h -> h IS NOT NULL)"))
    )

    def stands(start: str, phrase: str) -> str:
        n = len(phrase.split())
        part = f"array_join(slice(__words, greatest({start}, 0) + 1, {n}), ' ')"
        return f"({start} >= 0 AND lower({part}) = '{phrase}' AND octet_length({part}) = {len(phrase)})"

    each = []
    for phrase, label in base.items():
        n = len(phrase.split())
        start = f"h.i - {n - 1}"
        each.append(
            f"transform(filter(__hits, h -> h.w = '{phrase.split()[-1]}' AND {stands(start, phrase)}),"
            f" h -> struct({start} AS at, {n} AS n, '{label}' AS label))"
        )
    found = found.withColumn("base", F.expr(f"array_sort(concat({', '.join(each)}))"))

    # one lookup for all templates: a template's number and a word's place in it
    postings: dict[str, list[str]] = {}
    for n, entries in enumerate(index):
        for w, i, weight in entries:
            postings.setdefault(w, []).append(f"named_struct('t', {n}, 'i', {i}, 'x', cast({weight!r} AS double))")
    lookup = ", ".join(f"'{w}', array({', '.join(p)})" for w, p in sorted(postings.items()))
    totals = [sum(w for *_, w in entries) for entries in index]
    of = lambda values, t: f"element_at(array({', '.join(values)}), {t} + 1)"
    kind = "array<struct<t:int,d:int,x:double>>"
    votes = f"flatten(transform(__hits, h -> transform(coalesce(element_at(map({lookup}), h.w), array()), p -> named_struct('t', p.t, 'd', h.i - p.i, 'x', p.x))))"
    start = f"named_struct('t', cast(NULL AS int), 'd', cast(NULL AS int), 'x', 0D, 'found', cast(array() AS {kind}))"
    needed = of([f"{threshold * x!r}D" for x in totals], "a.t")
    found_so_far = f"IF(a.x >= {needed}, concat(a.found, array(named_struct('t', a.t, 'd', a.d, 'x', a.x))), a.found)"
    same = "a.t = v.t AND a.d = v.d"
    step = f"named_struct('t', v.t, 'd', v.d, 'x', IF({same}, a.x + v.x, v.x), 'found', IF({same}, a.found, {found_so_far}))"
    # votes in order of the beginning they stand for, so that equal ones add up
    enough = f"aggregate(array_sort(cast({votes} AS {kind})), {start}, (a, v) -> {step}, a -> {found_so_far})"
    phrases = [t.phrase for t in templates]
    at = "(b.d + " + of([str(t.text.split(t.phrase)[0].count(" ")) for t in templates], "b.t") + ")"
    part = f"array_join(slice(__words, greatest({at}, 0) + 1, {of([str(len(p.split())) for p in phrases], 'b.t')}), ' ')"
    phrase = of([f"'{p}'" for p in phrases], "b.t")
    proved = f"{at} >= 0 AND lower({part}) = {phrase} AND octet_length({part}) = octet_length({phrase})"
    label, score = of([f"'{t.label}'" for t in templates], "b.t"), f"least(b.x / {of([f'{x!r}D' for x in totals], 'b.t')}, 1D)"
    matches = f"transform(filter({enough}, b -> {proved}), b -> struct({label} AS label, {score} AS score, b.d AS at))"
    none = "cast(array() AS array<struct<label:string,score:double,at:int>>)"
    return found.withColumn("matches", F.expr(f"CASE WHEN size(__hits) = 0 THEN {none} ELSE {matches} END")).drop("__words", "__hits")


def op3_rare_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_labels = "array_distinct(transform(base, b -> b.label))"
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.expr("cast(array_min(transform(base, b -> b.at)) AS bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(base, b -> b.at)) AS bigint)").alias("last_word"),
        F.expr(f"array_join(array_sort({base_labels}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base_labels}, transform(matches, m -> m.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(matches, m -> m.score)), 0D)").alias("score"),
    )
