from __future__ import annotations

import random
import re

import pytest
from oracle import SMALL

from quillstream.llm import license_scan

BASE = [(t.label, t.phrases[0].split()) for t in license_scan.BASE]


def words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text):
    w = words(text)
    places = [(i, label) for label, p in BASE for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text, templates=license_scan.BASE + license_scan.NOTICES):
    w, found = words(text), set()
    for t in templates:
        starts = [[i for i in range(len(w) - len(p.split()) + 1) if w[i : i + len(p.split())] == p.split()] for p in t.phrases]
        first = starts[0]
        for rest in starts[1:]:
            first = [s for s in first if any(s < r <= s + t.window for r in rest)]
        if first:
            found.add(t.label)
    return ",".join(sorted(found))


TEXTS = [
    None, "", "MIT License", "mit  LICENSE, mit-license; the MIT\nLicense", "mit licenses", "MITLicense", "license mit license mit license", "apache license" * 3,
    "GNU General Public License, version 3 and the MIT License", "general public general public license", "Licensed under CC BY-NC 4.0.", "ÀMIT License MIT Licenseé", "Ap\u212ache License MIT LICEN\u0130SE m\u0130t license \u212ait", "apache LICENSE APACHE license",
    "Permission is hereby granted, free of charge, to any person " + "to deal in it " * 5 + "without restriction", "Permission is hereby granted, free of charge, " + "x " * 100 + "without restriction",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "without restriction permission is hereby granted free of charge",
    "mit license " * 20_000, "This is free and unencumbered software released into the public domain", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0",
]


def test_texts(spark, frame):
    docs = frame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "x"), (None, "the MIT License", "x")], "doc_id bigint, text string, words string")
    got = license_scan.scan(spark, docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "the MIT License"
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
        assert r["labels"] == brute_labels(text)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


@pytest.mark.parametrize("table", [SMALL])
def test_table(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in license_scan.scan(spark, docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = license_scan.scan(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert license_scan.scan(spark, docs.limit(0)).count() == 0


def generated(n):
    """Templates of one or two phrases over a small vocabulary, so that many share words and places."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    phrase = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(1, 5)))
    return [license_scan.Template(f"t{k}", tuple(phrase() for _ in range(rng.choice([1, 1, 2]))), 15) for k in range(n)]


def test_many_templates(spark, frame):
    templates = generated(200)
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        text = [f"w{rng.randrange(90)}" for _ in range(rng.randrange(200))]
        for t in rng.sample(templates, 2):
            for p in t.phrases:
                at = rng.randrange(len(text) + 1)
                text[at:at] = p.split()
        texts.append(" ".join(text))
    docs = frame(list(enumerate(texts)), "doc_id bigint, text string")
    got = license_scan.scan(spark, docs, templates=templates)
    seen = 0
    for r in got.collect():
        assert r["labels"] == brute_labels(texts[r["doc_id"]], templates)
        seen += r["labels"].count("t")
    assert seen > 240
    # Nothing in the plan is repeated by template.
    size = lambda df: len(re.findall("lambda", df._jdf.queryExecution().analyzed().toString()))
    assert size(got) == size(license_scan.scan(spark, docs, templates=templates[:3]))
