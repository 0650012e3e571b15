import math
import random

import pytest

from marlstone.llm.license_scan import BASE, TEMPLATES, scan_licenses

from .conftest import folded


def expected(text):
    words, places, labels = folded(text), [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def held(df, texts):
    got = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    return got


def test_places_and_labels(docs):
    texts = [
        None, "", "MIT License", "mit-license, MIT LICENSE mit license", "the mit of license", "Éla General  Public\nLicense x",
        "Licensed under the Apache License, Version 2.0.", "licensed under CC BY-NC 4.0", "license " * 3 + "public license general public license",
        "a " * 60_000 + "apache license", "mıt license MIT LİCENSE",
    ]
    got = held(scan_licenses(docs(texts)), texts)
    assert "apache-2.0" in got[6].labels.split(",") and got[7].labels == "cc-by-nc" and got[7].base_labels == "" and got[7].score > 0.5


def test_empty_and_repeated(docs):
    assert scan_licenses(docs([])).count() == 0
    assert [r.n_base for r in scan_licenses(docs(["MIT License"] * 3, [1, 1, None])).collect()] == [1, 1, 1]


def test_table(spark, sf001):
    table = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in scan_licenses(table).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(texts[r.doc_id])


def test_notices_by_brute_force(spark, docs):
    rng = random.Random(3)
    words = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    texts = [None, "", "the mozilla public license applies", "Permission is hereby granted, free of charge, to any person", "mit license " * 2000]
    for _ in range(60):
        _, t, key = rng.choice(TEMPLATES)
        own = t.split()
        a = rng.randint(0, len(own))
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randint(0, 20))] + rng.choice([own, own[a:], key.split(), own[:a]]) + ["x"] * rng.randint(0, 5)))
    folds = [folded(t) for t in texts]
    vocabulary = set(words) | {w for p in BASE.values() for w in p.split()}
    idf = {w: math.log((len(texts) + 1) / (sum(w in f for f in map(set, folds)) + 0.5)) + 1 for w in vocabulary}
    got = {r.doc_id: r for r in scan_licenses(docs(texts)).collect()}
    for i, f in enumerate(folds):
        best = {}
        for label, t, key in TEMPLATES:
            t, key = t.split(), key.split()
            offset = next(j for j in range(len(t)) if t[j : j + len(key)] == key)
            whole = sum(idf[w] for w in t)
            enough = min(0.25, sum(idf[w] for w in key) / whole)
            for s in range(-offset, len(f)):
                if f[s + offset : s + offset + len(key)] == key:
                    share = sum(idf[w] for j, w in enumerate(t) if 0 <= s + j < len(f) and f[s + j] == w) / whole
                    if share >= enough - 1e-9:
                        best[label] = max(best.get(label, 0), share)
        labels = set(best) | set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(labels))
        assert got[i].score == pytest.approx(1.0 if got[i].base_labels else max(best.values(), default=0))
    assert got[2].labels == "mpl" and got[3].labels == "mit-text"
