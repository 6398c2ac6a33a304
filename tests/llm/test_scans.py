import random
import re

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import licenses, secrets

from ..conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    found = [(label, i) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for _, i in found), default=None), max((i for _, i in found), default=None), ",".join(sorted({x for x, _ in found}))


def test_base_against_a_loop(spark):
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op5_positional_license_scan(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert found == {d.doc_id: base_places(d.text) for d in docs}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("x. Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("Released under the MIT License. All Rights Reserved", {"mit"}),
        ("under the GNU General Public License, version 3", {"gpl-3.0"}),
        ("permitted by MIT, license to follow", set()),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", {"mit"}),
        ("Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following terms are met", {"bsd"}),
        ("Redistribution and use in binary and source forms, with or without modification, are permitted provided that the following conditions are met", set()),
        ("x " * 200_000 + "released under the mit license", {"mit"}),
        ("a public general license", set()),
    ],
)
def test_templates(spark, text, labels):
    docs = spark.createDataFrame([(1, text)] + [(k, "the under by version of a plain text") for k in range(2, 30)], "doc_id long, text string")
    found = licenses.scan(docs, licenses.weights(docs)).where("doc_id = 1").first().found
    assert {f.label for f in found} == labels and all(0 < f.score <= 1 for f in found)


def test_templates_against_a_loop(spark):
    """Every place of every template, with words left out, changed and moved, is judged as a loop over all starts judges it."""
    rng = random.Random(11)
    texts = []
    for k in range(160):
        words = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1].split()
        words = [rng.choice(["the", "license", "zebra"]) if rng.random() < rng.choice([0, 0.1, 0.3, 0.5]) else w for w in words]
        if rng.random() < 0.3:
            del words[rng.randrange(len(words))]
        texts.append(" ".join(rng.choices(["plain", "of", "under", "software", "version"], k=rng.randint(0, 30)) + words + ["to", "the"] * rng.randint(0, 3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licenses.weights(docs)
    found = {r.doc_id: sorted((f.label, f.start, round(f.score, 9)) for f in r.found) for r in licenses.scan(docs, idf).collect()}
    for k, t in enumerate(texts):
        w, want = t.split(), []
        for label, words, must in licenses.TEMPLATES:
            ws, ms = words.split(), must.split()
            at = next(j for j in range(len(ws)) if ws[j : j + len(ms)] == ms)
            for s in range(-len(ws), len(w)):
                mass = sum(idf[x] for j, x in enumerate(ws) if 0 <= s + j < len(w) and w[s + j] == x) / sum(idf[x] for x in ws)
                if mass >= licenses.COVERAGE and s + at >= 0 and w[s + at : s + at + len(ms)] == ms:
                    want.append((label, s, round(mass, 9)))
        assert found[k] == sorted(want)


def test_licences_of_odd_rows(odd, none):
    idf = licenses.weights(odd)
    rows = licenses.scan(odd, idf).collect()
    assert len(rows) == odd.count() and {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert licenses.scan(none, licenses.weights(none)).count() == 0


KEY = "3f9a0c7d5b1e8842aa67c0ffee1234567890abcd"


def test_secrets(spark):
    rows = [
        (1, f'so token = "{KEY}" end and again {KEY}', "src"), (2, f"see commit {KEY} for more", "src"), (3, 'token = "your_token_goes_here_123" yes', "src"),
        (4, "card 4111111111111111 paid", "src"), (5, "no candidates", "src"), (6, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.places, r.secret) for r in secrets.scan(docs).collect()}
    assert found == {1: (2, True), 2: (1, False), 3: (1, False), 4: (1, False)}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[1] == 'so token = "[secret]" end and again [secret]' and clean[2] == rows[1][1] and clean[6] is None


def test_secrets_at_any_place(spark):
    """The first place of a key says nothing of the others, and what is assigned to a name may be short or of any characters."""
    letters = "qWzRtPlKjHgFdSxCvBnMqWxZrTkLpN"
    long = KEY + "77aa10"
    rows = [
        (1, f'see commit {KEY} and\nthen token = "{KEY}" end'), (2, f'x{KEY} first, token = "{KEY}"'), (3, 'password = "Tr0ub4dor&3" ok'), (4, "DB_PASSWORD=Tr0ub4dor&3\nuser"),
        (5, f'api_key = "{letters}"'), (6, 'password = "winterdragon"'), (7, f'token = "{KEY}" then secret = "{long}"'), (8, f"AWS_SECRET_ACCESS_KEY={KEY}\n"),
        (9, 'pwd: "ma!9xq" and ma!9xq 😀'), (10, "the token: a small unit of internationalization/organization"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("src"))
    found = {(r.doc_id, r.token): (r.places, r.secret) for r in secrets.scan(docs).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert found[1, KEY] == (2, True) and found[2, KEY] == (1, True) and found[4, "Tr0ub4dor&3"] == (1, True)
    assert clean == {
        1: 'see commit [secret] and\nthen token = "[secret]" end', 2: 'x[secret] first, token = "[secret]"', 3: 'password = "[secret]" ok', 4: "DB_PASSWORD=[secret]\nuser",
        5: 'api_key = "[secret]"', 6: 'password = "[secret]"', 7: 'token = "[secret]" then secret = "[secret]"', 8: "AWS_SECRET_ACCESS_KEY=[secret]\n",
        9: 'pwd: "[secret]" and [secret] 😀', 10: rows[9][1],
    }


def test_forest_on_other_findings(spark):
    """Rows that it was not fitted on: those past the first LABELLED."""
    score = secrets.forest(secrets.labelled_findings(spark))
    more = secrets.labelled_findings(spark, secrets.LABELLED + 3000)
    fitted = secrets.labelled_findings(spark)
    fresh = more.join(fitted.select("token"), "token", "left_anti")
    looked = fresh.select("label", F.struct(*[c.alias(n) for n, c in secrets.features(F.struct("token", "before", "after"), F.col("path")).items()]).alias("f"))
    held = looked.select("label", (score(F.col("f")) >= secrets.SECRET).alias("said"))
    n = {(r.label, r.said): r["count"] for r in held.groupBy("label", "said").count().collect()}
    right = n.get((1.0, True), 0) + n.get((0.0, False), 0)
    assert right / sum(n.values()) > 0.95


def test_secrets_of_odd_rows(odd, none):
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()
    assert secrets.scan(none).count() == 0


def test_licence_twin(spark, duck):
    from ..twins import check

    check(licenses.op5_positional_license_scan, licenses.SQL_OP5, spark, duck, SMALL)
