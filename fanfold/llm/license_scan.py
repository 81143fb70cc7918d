"""License scans by a positional index of rare words, in DataFrame functions only.

A template is a licence's wording with mandatory key phrases in it. :func:`build_index` weighs every template word by its
inverse document frequency over all documents and notes, for each template, its rarest key word and where it stands.
:func:`scan` then works inside each row, so nothing is shuffled and no document meets another:

1. the file's licence words are looked up from the highest IDF down; a template whose key words are not all there is out;
2. the places of the remaining templates' rarest key words give relative positions, one per place and template;
3. at each of them the key phrases must stand whole, and the share of the template's weight found at the same relative
   positions is its coverage.

As every key phrase holds its template's rarest key word, no place is lost. Templates are few and their index is a literal.

Defined cases: NULL text counts as empty and has no words. NULL ids and repeated rows give a row each; an empty table gives
an empty result, and without documents all words weigh the same. Other columns are not read. A template may begin
before a text or end after it, as long as its key phrases are inside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import id_and_text
from fanfold.operators.ordering import computed_once

COVERAGE = 0.75


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


def phrase(label: str, text: str, base: bool = False) -> Template:
    """A template that is one key phrase."""
    return Template(label, text, (text,), base)


# The base phrases, then the openings of well-known public licences and usual notices.
TEMPLATES = (
    phrase("cc-by", "cc by", base=True),
    phrase("gpl", "general public license", base=True),
    phrase("reserved", "all rights reserved", base=True),
    phrase("mit", "the mit license"),
    phrase("mit", "spdx license identifier mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction",
             ("permission is hereby granted", "deal in the software without restriction")),
    phrase("apache-2.0", "the apache license version 2 0"),
    phrase("apache-2.0", "spdx license identifier apache 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
             "http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
             "the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
             "granted", ("for any purpose with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    phrase("cc-by", "creative commons attribution"),
)


def words_of(text: Column) -> Column:
    """The words of a text; only words of ASCII letters and digits are ever compared.

    ``lower`` changes other letters too, which leaves the words' borders as they are; the one sign that it would turn
    into an ASCII letter, the Kelvin sign, is replaced first.
    """
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def find_words(words: Sequence[str], part: Sequence[str]) -> int:
    return next(i for i in range(len(words)) if list(words[i:i + len(part)]) == list(part))


class Index(NamedTuple):
    """Template words from the highest weight down, and the templates as a literal."""

    weights: dict[str, int]
    vocabulary: Column
    templates: Column


def build_index(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> Index:
    """Weights from all documents, one small row per template word: ``1 + floor(1000 * ln((N + 1) / (n + 1)))``."""
    known = vocabulary(templates)
    held = F.array_intersect(literals(known), words_of(F.col(text_col).cast("string")))
    # The empty word stands for the documents themselves.
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    weights = {w: 1 + math.floor(1000 * math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1))) for w in known}
    rarest = sorted(known, key=lambda w: (-weights[w], w))
    return Index(weights, literals(rarest), F.array(*[as_literal(t, weights) for t in templates]))


def as_literal(template: Template, weights: dict[str, int]) -> Column:
    words, keys = template.text.split(), [k.split() for k in template.keys]
    starts = [find_words(words, k) for k in keys]
    spots = {w: s + i for k, s in reversed(list(zip(keys, starts))) for i, w in reversed(list(enumerate(k)))}
    rarest = sorted(spots, key=lambda w: (-weights[w], w))
    return F.struct(
        F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), literals(words).alias("words"),
        F.array(*[F.lit(weights[w]).cast("long") for w in words]).alias("weights"),
        F.lit(sum(weights[w] for w in words)).cast("long").alias("total"), literals(rarest).alias("key_words"),
        F.lit(rarest[0]).alias("anchor"), F.lit(spots[rarest[0]]).alias("anchor_at"),
        F.array(*[F.struct(F.lit(s).alias("at"), literals(k).alias("words")) for s, k in zip(starts, keys)]).alias("keys"))


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and ``found``: label, base, start (word number, may be negative) and coverage of every place at which
    a template's key phrases stand."""
    rows = computed_once(id_and_text(docs, id_col, text_col), words=words_of(F.col("text")))
    rows = computed_once(rows.select("doc_id", "words"), present=F.array_intersect(index.vocabulary, F.col("words")))
    rows = computed_once(rows, likely=F.filter(
        index.templates, lambda t: F.forall(t["key_words"], lambda w: F.array_contains(F.col("present"), w))))
    anchors = F.transform("likely", lambda t: t["anchor"])
    places = F.array_compact(F.transform("words", lambda w, i: F.when(
        F.array_contains(anchors, w), F.struct(w.alias("word"), i.alias("at")))))
    rows = computed_once(rows, places=F.when(F.size("likely") > 0, places).otherwise(F.slice(places, 1, 0)))
    words = F.col("words")

    def verified(t: Column, start: Column) -> Column:
        return F.forall(t["keys"], lambda k: (start + k["at"] >= 0) & (
            F.slice(words, start + k["at"] + 1, F.size(k["words"])) == k["words"]))

    def coverage(t: Column, start: Column) -> Column:
        got = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0).cast("long"), lambda total, i: total + F.when(
            F.get(words, start + i).eqNullSafe(F.get(t["words"], i)), F.get(t["weights"], i)).otherwise(F.lit(0).cast("long")))
        return got.cast("double") / t["total"].cast("double")

    def at_places(t: Column) -> Column:
        starts = F.transform(F.filter("places", lambda p: p["word"] == t["anchor"]), lambda p: p["at"] - t["anchor_at"])
        return F.transform(F.filter(starts, lambda s: verified(t, s)), lambda s: F.struct(
            t["label"].alias("label"), t["base"].alias("base"), s.cast("long").alias("start"), coverage(t, s).alias("coverage")))

    rows = computed_once(rows, found=F.flatten(F.transform("likely", at_places)))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "found")


def report(found: DataFrame, least: float = COVERAGE) -> DataFrame:
    """One row per document with places of base phrases, labels, and the best coverage as score."""
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda f: f["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.filter("found", lambda f: f["coverage"] >= least)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)).alias("score"))


def template_rows(templates: Sequence[Template]) -> str:
    """SQL rows (template, label, base, place, word, whether it is of a key phrase)."""
    rows = []
    for n, t in enumerate(templates):
        words, keys = t.text.split(), [k.split() for k in t.keys]
        key_places = {s + i for k in keys for s in [find_words(words, k)] for i in range(len(k))}
        rows += [f"({n}, '{t.label}', {t.base}, {i}, '{w}', {i in key_places})" for i, w in enumerate(words)]
    return ", ".join(rows)


ORACLE = r"""
WITH template(t, label, base, p, word, is_key) AS (VALUES @ROWS),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (
  SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d)
  SEMI JOIN template USING (word)),
weight AS (
  SELECT word, 1 + floor(1000 * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(n, 0) + 1)))::BIGINT AS weight
  FROM (SELECT DISTINCT word FROM template) LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS n FROM place GROUP BY 1) USING (word)),
whole AS (
  SELECT t, any_value(label) AS label, any_value(base) AS base, sum(weight) AS total, count(*) FILTER (is_key) AS n_keys
  FROM template JOIN weight USING (word) GROUP BY 1),
found AS (
  SELECT doc_id, t, pos - p AS start, sum(weight) AS got, count(*) FILTER (is_key) AS n
  FROM place JOIN template USING (word) JOIN weight USING (word) GROUP BY ALL),
verified AS (
  SELECT doc_id, label, base, start, got::DOUBLE / total::DOUBLE AS coverage FROM found JOIN whole USING (t) WHERE n = n_keys),
named AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label) FILTER (coverage >= 0.75))), ',') AS labels, max(coverage) AS score
  FROM verified GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN named USING (doc_id)
""".replace("@ROWS", template_rows(TEMPLATES))
