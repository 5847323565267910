"""Licence scan by a positional index of rare words.

A template is a list of words, some of which (its key phrases) must be there.
The inverse document frequency of the template words is taken over all
documents. In a text the positions of each template's two rarest key words are
looked up; where both, less their places in the template, give the same start,
the key phrases are verified word by word. All of it is DataFrame functions on
the row itself, so nothing is shuffled but the counts of the words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import require_columns


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, ...]  # places of the words that must be there
    base: bool = False


def _template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    """A template whose key phrases are given; without any the whole text is one."""
    words = tuple(text.split())
    key: set[int] = set()
    for phrase in phrases or (text,):
        own = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        key |= set(range(at, at + len(own)))
    return Template(label, words, tuple(sorted(key)), base)


# The base phrases and their labels.
BASE = [
    _template("mit", "mit license", base=True),
    _template("apache", "apache license", base=True),
    _template("gpl", "general public license", base=True),
]
#: Published licence notices, as words.
NOTICES = [
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _template("lgpl", "gnu lesser general public license"),
    _template("agpl", "gnu affero general public license"),
    _template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge", "obtaining a copy"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "without modification"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    _template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    _template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    _template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    _template("all-rights-reserved", "all rights reserved"),
]
# Fixed value: a word is a run of other characters than these, A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; null texts have none.

    Letters beyond A-Z are lower-cased, too, which changes no word of a template.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Number of documents that hold each word of a bounded vocabulary, over all documents."""
    own = F.array_intersect(words_of(F.col(text)), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in rows.collect()}


def _starts(words: Column, hits: Column, t: Template, frequency: dict[str, int]) -> Column:
    """Places of a template: starts on which its two rarest key words agree, with its key phrases verified."""
    rare = sorted(t.key, key=lambda i: (frequency.get(t.words[i], 0), -len(t.words[i]), i))[:2]

    def aligned(o: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["word"] == t.words[o]), lambda h: h["at"] - o)

    starts = F.array_intersect(*(aligned(o) for o in rare)) if len(rare) > 1 else F.array_distinct(aligned(rare[0]))

    def verified(s: Column) -> Column:
        ok = (s + t.key[0] >= 0) & (s + t.key[-1] < F.size(words))
        for o in t.key:
            ok = ok & (F.get(words, s + o) == t.words[o])
        return ok

    return F.filter(starts, verified)


def _coverage(words: Column, starts: Column, t: Template) -> Column:
    """Share of the template's words in place, at the best start."""

    def count(s: Column) -> Column:
        found = F.lit(0)
        for o, w in enumerate(t.words):
            found = found + F.when((s + o >= 0) & (F.get(words, F.greatest(s + o, F.lit(0))) == w), 1).otherwise(0)
        return found

    return F.coalesce(F.array_max(F.transform(starts, count)) / len(t.words), F.lit(0.0))


def license_scan(docs: DataFrame, templates: list[Template] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest first words (null without
    any), ``labels`` are those of all templates whose key phrases stand at their
    places, ``score`` is the best share of a template's words found (0 without
    any). Whole texts are searched; a null or empty text has no words and no
    labels. Repeated rows and rows without an id are scanned like any other;
    other columns are ignored; an empty table gives an empty result.
    """
    require_columns(docs, key, text)
    templates = BASE + NOTICES if templates is None else templates
    vocabulary = sorted({t.words[o] for t in templates for o in t.key})
    frequency = document_frequencies(docs, vocabulary, text)
    rarest = sorted({min((t.words[o] for o in t.key), key=lambda w: (frequency[w], -len(w), w)) for t in templates})
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), words_of(F.col(text)).alias("words"))
    some = F.arrays_overlap("words", F.array(*[F.lit(w) for w in rarest]))
    listed = F.array(*[F.lit(w) for w in vocabulary])
    places = F.filter(
        F.transform("words", lambda w, i: F.when(F.array_contains(listed, w), F.struct(w.alias("word"), i.alias("at")))),
        lambda h: h.isNotNull(),
    )
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(some, F.col("words")).alias("words"), F.when(some, places).alias("hits"))
    starts = [_starts(F.col("words"), F.col("hits"), t, frequency).alias(f"s{i}") for i, t in enumerate(templates)]
    rows = rows.select("doc_id", "n_words", "words", *starts)
    found = [F.coalesce(F.size(f"s{i}") > 0, F.lit(False)) for i in range(len(templates))]
    base = [i for i, t in enumerate(templates) if t.base]

    def labels(which: list[int]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(found[i], F.lit(templates[i].label)) for i in which]), lambda x: x.isNotNull()))), ",")

    every = F.flatten(F.array(*[F.coalesce(F.col(f"s{i}"), F.array().cast("array<int>")) for i in base]))
    score = F.greatest(*[F.when(found[i], _coverage(F.col("words"), F.col(f"s{i}"), t)).otherwise(0.0) for i, t in enumerate(templates)])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(list(range(len(templates)))).alias("labels"),
        score.alias("score"),
    )


def scan_sql(templates: list[Template] | None = None) -> str:
    """The scan of a table ``documents`` with distinct ids, in DuckDB's SQL."""
    templates = BASE + NOTICES if templates is None else templates
    rows = ", ".join(f"('{t.label}', {t.base}, {o}, '{w}', {int(o in t.key)})" for t in templates for o, w in enumerate(t.words))
    return f"""
WITH t(label, base, o, word, must) AS (VALUES {rows}),
n AS (SELECT label, count(*) AS size, sum(must) AS musts FROM t GROUP BY label),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
p AS (
  SELECT w.doc_id, t.label, t.base, w.pos - t.o AS s, count(*) AS c, sum(must) AS m
  FROM w JOIN t ON w.word = t.word GROUP BY ALL),
f AS (SELECT p.*, c / n.size AS share FROM p JOIN n USING (label) WHERE m = n.musts),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)
"""
