"""Licence scan with a positional rare-token index.

The index holds the licence templates word by word with their positions, and a weight (IDF over the documents) for each word.
Posting lists hold the highest-IDF words of each template, as many as a place with COVERAGE of the template can't do without. A file's
words are looked up there; every hit proposes a template and a start, which is its position less the word's position in
the template. At that start the other words are intersected by relative position, their weights give the
coverage, and the template's mandatory phrase is verified. So every place with enough of a template is found, whichever of its
words differ. Only DataFrame functions are used; the index is a literal whose size is that of the templates.

Defined cases: a null text is empty and has no words, places or labels; repeated rows are scanned each on their own; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A word's characters, before A-Z are lowered (upper-case letters are word characters already).
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = f"{INSIDE}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method: label, words of the notice or of the licence's text, mandatory phrase.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "this source code form is subject to the terms"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]
#: Share of a template's weight that must stand in place.
COVERAGE = 0.6


def words_of(text: str) -> Column:
    """All words, in the case that they have."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def lowered(w: Column) -> Column:
    return F.translate(w, UPPER, LOWER)


def any_of(words: list[str]) -> str:
    """A pattern of these whole words in any case; they are ASCII."""
    return f"(?i)(?<!{INSIDE})(?:{'|'.join(words)})(?!{INSIDE})"


def weights(docs: DataFrame, *, text: str = "text") -> dict[str, float]:
    """IDF of every word of the index over all documents. What is collected has a count for each such word, no more."""
    vocabulary = sorted({w for _, words, _ in TEMPLATES for w in words.split()} | {w for p in BASE for w in p.split()})
    held = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(any_of(vocabulary)), F.lit(0))
    found = docs.select(F.array_distinct(F.transform(held, lowered)).alias("w"))
    # one row: the documents in all, and those with each word
    has = [F.count_if(F.array_contains("w", w)).alias(f"n{k}") for k, w in enumerate(vocabulary)]
    counts = found.agg(F.count("*").alias("n"), *has).first()
    return {w: math.log(1 + (counts.n + 1) / (counts[f"n{k}"] + 1)) for k, w in enumerate(vocabulary)}


def lookups(idf: dict[str, float], coverage: float) -> list[list[int]]:
    """Of each template the positions of its highest-IDF words, as many as are needed so that the others have less than coverage of
    its weight: a place with enough of the template has one of them where it should be."""
    out = []
    for _, words, _ in TEMPLATES:
        ws = words.split()
        order, lost, chosen = sorted(range(len(ws)), key=lambda j: (-idf[ws[j]], j)), 0.0, []
        for j in order:
            if sum(idf[w] for w in ws) - lost < coverage * sum(idf[w] for w in ws) - 1e-9:
                break
            chosen.append(j)
            lost += idf[ws[j]]
        # a word stands in the index with all its positions
        out.append([j for j, w in enumerate(ws) if w in {ws[k] for k in chosen}])
    return out


def index(idf: dict[str, float], coverage: float) -> dict[str, list[tuple[int, int]]]:
    """Posting lists: the templates and positions of each word that is looked up."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, ((_, words, _), places) in enumerate(zip(TEMPLATES, lookups(idf, coverage), strict=True)):
        for j in places:
            found.setdefault(words.split()[j], []).append((t, j))
    return found


def _base_places(at: Column, words: Column, label: str, phrase: list[str], anchor: int) -> Column:
    begin = F.transform(F.filter(at, lambda x: x.w == phrase[anchor]), lambda x: x.i - anchor)
    whole = F.array(*map(F.lit, phrase))
    starts = F.filter(begin, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, len(phrase)) == whole))
    return F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))


def _template_places(at: Column, words: Column, idf: dict[str, float], coverage: float) -> Column:
    """(label, start, score) of the places where a template stands. The templates are literals, so the plan does not grow with them."""
    postings = F.create_map(*[c for w, ps in index(idf, coverage).items() for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(j).alias("j")) for t, j in ps]))])
    rows = []
    for label, text, phrase in TEMPLATES:
        ws, must = text.split(), phrase.split()
        total = sum(idf[w] for w in ws)
        weighed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(idf[w] / total).alias("part")) for w in ws])
        rows.append(F.struct(F.lit(label).alias("label"), weighed.alias("words"), F.lit(_phrase_at(ws, must)).alias("must_at"), F.array(*map(F.lit, must)).alias("must")))
    templates = F.array(*rows)
    proposed = F.transform(at, lambda x: F.transform(F.try_element_at(postings, x.w), lambda p: F.struct(p.t.alias("t"), (x.i - p.j).alias("start"))))
    begins = F.array_distinct(F.flatten(F.filter(proposed, lambda x: x.isNotNull())))

    def judged(x: Column) -> Column:
        own = F.get(templates, x.t)
        parts = F.transform(own.words, lambda e, j: F.when(F.get(words, x.start + j) == e.w, e.part).otherwise(F.lit(0.0)))
        mass = F.least(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.lit(1.0))
        first = x.start + own.must_at
        whole = (first >= 0) & (F.slice(words, F.greatest(first, F.lit(0)) + 1, F.size(own.must)) == own.must)
        return F.struct(own.label.alias("label"), x.start.alias("start"), mass.alias("score"), whole.alias("whole"))

    kept = F.filter(F.transform(begins, judged), lambda x: (x.score >= coverage) & x.whole)
    return F.transform(kept, lambda x: F.struct(x.label.alias("label"), x.start.alias("start"), x.score.alias("score")))


def _phrase_at(words: list[str], phrase: list[str]) -> int:
    return next(j for j in range(len(words)) if words[j : j + len(phrase)] == phrase)


def scan(docs: DataFrame, idf: dict[str, float], *, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, base (phrase, start), found (label, start, score)."""
    rarest = lambda words: max(range(len(words)), key=lambda j: (idf[words[j]], -j))
    looked_up = sorted({*index(idf, coverage)} | {p.split()[rarest(p.split())] for p in BASE})
    # only texts with one of these words are looked at word by word
    rows = docs.select(F.col(key), words_of(text).alias("all"), F.coalesce(F.col(text).rlike(any_of(looked_up)), F.lit(False)).alias("some"))
    none = F.array().cast("array<string>")
    rows = rows.select(key, F.size("all").cast("long").alias("n_words"), F.when(F.col("some"), F.transform("all", lowered)).otherwise(none).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("at", F.filter(placed, lambda x: x.w.isin(looked_up)))
    at, words = F.col("at"), F.col("words")
    base = [_base_places(at, words, label, p.split(), rarest(p.split())) for p, label in BASE.items()]
    some = F.size("at") > 0
    none_base, none_found = "array<struct<label:string,start:int>>", "array<struct<label:string,start:int,score:double>>"
    return rows.select(
        key,
        "n_words",
        F.when(some, F.concat(*base)).otherwise(F.array().cast(none_base)).alias("base"),
        F.when(some, _template_places(at, words, idf, coverage)).otherwise(F.array().cast(none_found)).alias("found"),
    )


def op5_positional_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, weights(docs))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    start = F.col("base.start")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).cast("long").alias("first_word"),
        F.array_max(start).cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("found.label"))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce(F.array_max("found.score"), F.lit(0.0)), 6)).alias("score"),
    )


def _rows(table_: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in table_)


_T = [(t, label, j, w) for t, (label, words, _) in enumerate(TEMPLATES) for j, w in enumerate(words.split())]
_M = [(t, _phrase_at(words.split(), must.split()) + k, w) for t, (_, words, must) in enumerate(TEMPLATES) for k, w in enumerate(must.split())]
_B = [(label, phrase, k, w) for phrase, label in BASE.items() for k, w in enumerate(phrase.split())]
#: Every place where a template's mandatory phrase stands is judged here.
SQL_OP5 = f"""
WITH t(id, label, j, w) AS (VALUES {_rows(_T)}), m(id, j, w) AS (VALUES {_rows(_M)}), b(label, phrase, j, w) AS (VALUES {_rows(_B)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
v AS (SELECT w, ln(1 + ((SELECT count(*) FROM d) + 1) / (count(DISTINCT doc_id) + 1)) AS idf FROM (SELECT w FROM t UNION SELECT w FROM b) LEFT JOIN p USING (w) GROUP BY w),
base AS (SELECT doc_id, b.label, i - j AS start FROM b JOIN p USING (w) JOIN (SELECT label, count(*) AS n FROM b GROUP BY label) k ON k.label = b.label GROUP BY doc_id, b.label, phrase, i - j HAVING count(*) = max(k.n)),
tv AS (SELECT t.*, idf, sum(idf) OVER (PARTITION BY id) AS total FROM t JOIN v USING (w)),
whole AS (SELECT doc_id, m.id, i - j AS start FROM m JOIN p USING (w) JOIN (SELECT id, count(*) AS n FROM m GROUP BY id) k ON k.id = m.id GROUP BY doc_id, m.id, i - j HAVING count(*) = max(k.n)),
found AS (SELECT s.doc_id, tv.label, s.id, s.start, sum(idf / total) AS score FROM whole s JOIN tv ON tv.id = s.id JOIN p ON p.doc_id = s.doc_id AND p.i = s.start + tv.j AND p.w = tv.w
  GROUP BY ALL HAVING sum(idf / total) >= {COVERAGE})
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(bl, '') AS base_labels,
  array_to_string(list_sort(list_filter(list_distinct(list_concat(string_split(coalesce(bl, ''), ','), string_split(coalesce(fl, ''), ','))), lambda x: x <> '')), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE WHEN best IS NULL THEN 0.0::DOUBLE ELSE round(least(best, 1), 6)::DOUBLE END AS score
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, min(start) AS low, max(start) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS bl FROM base GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, max(score) AS best, string_agg(DISTINCT label, ',' ORDER BY label) AS fl FROM found GROUP BY doc_id) USING (doc_id)
"""
