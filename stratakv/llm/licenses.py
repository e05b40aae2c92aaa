"""Licence scans through a positional index of rare words, with DataFrame functions only.

1. One pass over the texts: words (A-Z lowered), how many there are, and the places of words that any licence
   template has. That narrow table is written; texts are not read again.
2. Document frequencies of these words over all documents give their IDF. For each template the ``RARE`` words
   of highest IDF among its mandatory key phrases enter the index, with their places in the template.
3. A file's indexed words are looked up: each posting gives a relative position (where the template would begin).
   Places at which all of a template's rare words agree are candidates.
4. Candidates are verified: every word of the mandatory key phrases (the common ones too) must stand at its place, and of
   all the template's words at least ``COVERAGE``. As the rare words are key words, no place that verifies can be missed.

Places of a hot template are (document, place) rows; they are joined and counted by these keys, so a licence that a
third of all documents carry never gathers in one task. What the driver collects is bounded by the templates.

Defined results: null texts count as empty (0 words, no labels, score 0); rows that repeat an id are scanned on their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import keyed_text, materialize, prepare

#: Rare words looked up for each template, and the least share of a template's words that must be in place.
RARE, COVERAGE = 2, 0.6
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words too common to be looked up in the index. They are compared like all others once a place is a candidate.
COMMON = frozenset("a an and any as by copy for free in is of or person the this to under use used with without work".split())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of ``text`` of which every word must be in place.
    keys: tuple[str, ...]


#: Base phrases first, then sentences of well-known licences and notices.
BASE = (
    Template("mit", "mit license", ("mit license",)),
    Template("apache", "apache license", ("apache license",)),
    Template("gpl", "general public license", ("general public license",)),
)
NOTICES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    Template("mit-notice", "Released under the MIT License", ("released under the mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2", "GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl", "GNU Affero General Public License", ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "Mozilla Public License, version 2.0", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", ("distribute this software for any purpose",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("all-rights", "All rights reserved", ("all rights reserved",)),
)
TEMPLATES = BASE + NOTICES


def words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def key_phrases(t: Template) -> list[tuple[int, list[str]]]:
    """``(place in the template, words)`` of each mandatory phrase."""
    own, out = words(t.text), []
    for phrase in t.keys:
        p = words(phrase)
        out.append((next(k for k in range(len(own)) if own[k : k + len(p)] == p), p))
    return out


def places(t: Template) -> list[tuple[int, str, bool]]:
    """``(place, word, whether it is a key)`` of a template's words."""
    keys = {at + k for at, p in key_phrases(t) for k in range(len(p))}
    return [(k, w, k in keys) for k, w in enumerate(words(t.text))]


def lookup_places(t: Template) -> dict[str, int]:
    """First place of each key word that may be looked up: the common ones only if a template has no others."""
    first: dict[str, int] = {}
    for at, w, key in places(t):
        if key:
            first.setdefault(w, at)
    return {w: at for w, at in first.items() if w not in COMMON} or first


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_words, hits array<struct<pos long, word>>`` of each row; ``row`` tells repeated rows apart."""
    known = sorted({w for t in templates for _, w, _ in places(t)})
    gate = sorted({w for t in templates for w in lookup_places(t)})
    lowered = keyed_text(docs, id_col, text_col).select("doc_id", F.split(F.translate("text", UPPER, LOWER), SEPARATORS, -1).alias("parts"))
    lead = (F.element_at("parts", 1) == "").cast("int")
    trail = F.when(F.size("parts") > 1, (F.element_at("parts", -1) == "").cast("int")).otherwise(0)
    cut = lowered.select("doc_id", (F.size("parts") - lead - trail).cast("long").alias("n_words"), lead.alias("lead"), "parts")
    placed = F.filter(F.transform("parts", lambda w, i: F.struct((i - F.col("lead")).cast("long").alias("pos"), w.alias("word"))), lambda x: x["word"].isin(known))
    # most texts have none of the words that are looked up: those are not walked word by word
    some = F.arrays_overlap("parts", F.array(*map(F.lit, gate)))
    return cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.when(some, placed).alias("hits"))


def frequencies(found: DataFrame) -> dict[str, int]:
    """Documents that have each template word: as many numbers as the templates have words."""
    each = found.where("hits is not null").select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word"))
    return {r.word: r["count"] for r in each.groupBy("word").count().collect()}


def rare_places(templates: tuple[Template, ...], df: dict[str, int], rare: int = RARE) -> list[tuple[int, int, str]]:
    """``(template, place, word)`` of each template's key words of highest IDF, at most ``rare`` of them."""
    out = []
    for k, t in enumerate(templates):
        first = lookup_places(t)
        out += [(k, first[w], w) for w in sorted(first, key=lambda w: (df.get(w, 0), w))[:rare]]
    return out


def _constant(rows: list[tuple], columns: str, df: DataFrame) -> DataFrame:
    """Template rows as constants of the plan: bounded by the templates, so they are broadcast."""
    values = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


def template_places(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE, rare: int = RARE) -> DataFrame:
    """``row, template, start, score``: where templates stand. ``found``: materialised ``hits``."""
    spots = found.where("hits is not null").select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word")
    index = rare_places(templates, frequencies(found), rare)
    need: dict[int, int] = {}
    for k, _, _ in index:
        need[k] = need.get(k, 0) + 1
    postings = _constant(index, "template, place, word", found)
    wanted = _constant(list(need.items()), "template, need", found)
    # relative positions: one row for each (document, template, begin); all rare words must agree on it
    begun = spots.join(postings, "word").select("row", "template", (F.col("pos") - F.col("place")).alias("start")).where("start >= 0")
    agreed = begun.groupBy("row", "template", "start").agg(F.count("*").alias("n")).join(wanted, "template").where("n = need").select("row", "template", "start")
    body = [(k, at, w, key) for k, t in enumerate(templates) for at, w, key in places(t)]
    sizes = [(k, len(p), sum(key for _, _, key in p)) for k, p in ((k, places(t)) for k, t in enumerate(templates))]
    expected = agreed.join(_constant(body, "template, place, word, key", found), "template").select("row", "template", "start", (F.col("start") + F.col("place")).alias("pos"), "word", "key")
    there = expected.join(spots, ["row", "pos", "word"]).groupBy("row", "template", "start").agg(F.count("*").alias("n"), F.count_if("key").alias("n_keys"))
    score = F.col("n") / F.col("n_all")
    return there.join(_constant(sizes, "template, n_all, all_keys", found), "template").where((F.col("n_keys") == F.col("all_keys")) & (score >= coverage)).select("row", "template", "start", score.alias("score"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, n_base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of ``docs``.

    The first ``n_base`` templates are the base: ``n_base, first_word, last_word, base_labels`` are theirs.
    """
    prepare(docs.sparkSession)
    found = materialize(hits(docs, templates, id_col, text_col))
    base = F.col("template") < n_base
    named = F.element_at(F.array(*(F.lit(t.label) for t in templates)), F.col("template") + 1)
    by_row = template_places(found, templates).groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        _joined(F.collect_set(F.when(base, named))).alias("base_labels"), _joined(F.collect_set(named)).alias("labels"), F.max("score").alias("score"),
    )
    out = found.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(labels), ",")


def oracle(templates: tuple[Template, ...] = TEMPLATES, n_base: int = len(BASE), coverage: float = COVERAGE) -> str:
    """DuckDB SQL for ``scan``, from the phrases as strings: places where all of a template's phrases are read, without an index."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    whole = ", ".join(f"({k}, '{t.label}', {listed(words(t.text))}, {len(t.keys)})" for k, t in enumerate(templates))
    phrases = ", ".join(f"({k}, {at}, {len(p)}, '{p[0]}', '{' '.join(p)}')" for k, t in enumerate(templates) for at, p in key_phrases(t))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t(template, label, own, n_phrases) AS (VALUES {whole}),
k(template, place, n, head, phrase) AS (VALUES {phrases}),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
f AS (SELECT w.doc_id, template, pos - place AS start, n, phrase, pos FROM w JOIN k ON word = head WHERE pos >= place),
p AS (SELECT f.doc_id, f.template, start FROM f JOIN d USING (doc_id) JOIN t ON f.template = t.template WHERE array_to_string(words[pos + 1 : pos + n], ' ') = phrase GROUP BY 1, 2, 3 HAVING count(*) = any_value(n_phrases)),
v AS (SELECT doc_id, template, label, start, len(list_filter(range(len(own)), lambda i: words[start + i + 1] = own[i + 1])) / len(own) AS score FROM p JOIN d USING (doc_id) JOIN t USING (template)),
g AS (SELECT doc_id, count(*) FILTER (WHERE template < {n_base}) AS n_base, min(start) FILTER (WHERE template < {n_base}) AS first_word, max(start) FILTER (WHERE template < {n_base}) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE template < {n_base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM v WHERE score >= {coverage} GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id)
"""
