"""License scan by a positional index of rare words; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import checkpoint_folder

#: Phrases of the base labels (fixed values).
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Labels of the method: a notice's words and the key phrase that must stand at its place in them (fixed values).
TEMPLATES = (
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    ("bsd-notice", "released under the bsd license", "bsd license"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "released under the isc license", "isc license"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("cc0", "dedicated to the public domain under cc0", "cc0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def folded_words(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, with A-Z lower-cased; none for null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequencies(present: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and in how many of them each of the present words occurs (as many numbers as the notices have words)."""
    found = present.select(F.explode_outer(F.array_insert("present", 1, F.lit(None).cast("string"))).alias("word"))
    told = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return told.pop(None, 0), told


def scan_licenses(docs: DataFrame, *, base: dict[str, str] = BASE, templates=TEMPLATES, rare: int = 3, least: float = 0.25) -> DataFrame:
    """Licence notices of each document.

    ``docs`` has doc_id and text; other columns are ignored. One pass over the
    texts keeps of each document which words of the notices it has, and its
    words if it has all words of some key phrase; that small table is written to
    the shared folder. Counts over it give the IDF of the notices' words. Then
    each file's highest-IDF licence words are looked up: of the words that it
    shares with a notice, the ``rare`` of highest IDF (ties by word). Their
    positions less their positions in the notice are postings of places where it
    may begin, and the postings are intersected by place: two of the looked-up
    words must agree on it (one, if the key phrase has no second). There the key
    phrase is verified and all of the notice's words are compared; the score is
    the IDF share of those that stand in place. A base phrase
    counts wherever all its words stand consecutively.

    A verified key phrase gives its label from a share of ``least`` on, or
    wherever nothing but the key phrase of the notice stands. Nulls and empty
    texts have no words. Repeated rows each give a row. Returns doc_id, n_words,
    n_base, first_word, last_word, base_labels, labels, score (1 for a base
    phrase, else the best verified share, else 0) and notices (label and first
    word of each).
    """
    notices = [(label, words.split(), key.split()) for label, words, key in templates]
    phrases = [(label, phrase.split()) for label, phrase in base.items()]
    vocabulary = sorted({w for _, words, _ in notices for w in words} | {w for _, words in phrases for w in words})
    keys = sorted({tuple(sorted(set(key))) for *_, key in notices} | {tuple(sorted(set(words))) for _, words in phrases})
    # Of keys that hold another one the other says enough.
    keys = [k for k in keys if not any(set(o) < set(k) for o in keys)]
    path = f"{checkpoint_folder(docs.sparkSession)}/licence_words"
    worded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), folded_words(F.col("text")).alias("words"))
    worded = worded.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.array_intersect("words", _literal(vocabulary)).alias("present"), "words")
    may = F.exists(F.array(*[_literal(k) for k in keys]), lambda k: F.size(F.array_except(k, F.col("present"))) == 0)
    worded = worded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "present", F.when(may, F.col("words")).alias("words"))
    worded.write.parquet(path)
    scanned = docs.sparkSession.read.schema("row bigint, doc_id bigint, n_words bigint, present array<string>, words array<string>").parquet(path)
    n, frequency = document_frequencies(scanned)
    idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 0.5)) + 1 for w in vocabulary}
    by_idf = lambda words: sorted(dict.fromkeys(words), key=lambda w: (-idf[w], w))

    def template(label: str, words: list[str], key: list[str]) -> Column:
        offset, whole = next(i for i in range(len(words)) if words[i : i + len(key)] == key), sum(idf[w] for w in words)
        fields = {
            "label": F.lit(label),
            "words": _literal(words),
            "key": _literal(key),
            "offset": F.lit(offset),
            "ranked": _literal(by_idf(words)),
            "best": _literal(by_idf(key)[:rare]),
            "weights": F.array(*[F.lit(idf[w] / whole) for w in words]),
            "enough": F.lit(min(least, sum(idf[w] for w in key) / whole) - 1e-9),
            "agree": F.lit(min(2, len(set(key)))),
        }
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    # One row for each document and notice whose key phrase's words it has.
    every = F.array(*[template(*x) for x in notices])
    few = scanned.where("words is not null")
    # What depends on the notice alone is made once for it, as an output of explode; a projection would be repeated for each word.
    def looked(t: Column) -> Column:
        own = F.array_union(F.slice(F.filter(t["ranked"], lambda w: F.array_contains("present", w)), 1, rare), t["best"])
        postings = F.transform(t["words"], lambda w, p: F.struct(w.alias("w"), p.alias("p")))
        return F.struct(t.alias("t"), own.alias("looked_up"), F.filter(postings, lambda x: F.array_contains(own, x["w"])).alias("postings"))

    plausible = F.filter(every, lambda t: F.size(F.array_except(t["key"], F.col("present"))) == 0)
    asked = few.select("row", "words", F.explode(F.transform(plausible, looked)).alias("x")).select("row", "words", "x.t", "x.looked_up", "x.postings")
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains("looked_up", h["w"]))
    asked = asked.select("row", "words", "t", "looked_up", hits.alias("hits"), "postings")
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.filter("postings", lambda x: x["w"] == h["w"]), lambda x: h["i"] - x["p"])))
    asked = asked.select("row", "words", "t", "looked_up", "postings", F.array_distinct(votes).alias("places"))
    # A document may begin inside the notice, so a place may be negative while its key phrase stands.
    begins = lambda s: (s + F.col("t.offset") >= 0) & (F.slice("words", F.greatest(s + F.col("t.offset"), F.lit(0)) + 1, F.size("t.key")) == F.col("t.key"))
    at = lambda i: F.when(i >= 0, F.get("words", i))
    agreeing = lambda s: F.size(F.array_distinct(F.transform(F.filter("postings", lambda x: at(s + x["p"]) == x["w"]), lambda x: x["w"])))
    asked = asked.select("row", "words", "t", F.filter("places", lambda s: begins(s) & (agreeing(s) >= F.col("t.agree"))).alias("places"))
    place = F.explode("places").alias("s")
    share = F.aggregate(
        F.sequence(F.lit(0), F.size("t.words") - 1),
        F.lit(0.0),
        lambda total, j: total + F.when(F.coalesce(at(F.col("s") + j) == F.get("t.words", j), F.lit(False)), F.get("t.weights", j)).otherwise(0.0),
    )
    scored = asked.select("row", "words", "t", place).select("row", "t.label", "t.enough", F.greatest("s", F.lit(0)).cast("bigint").alias("at"), F.least(share, F.lit(1.0)).alias("score"))
    found = scored.where("score >= enough").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "at", "score"))).alias("found"))

    places = []
    for label, words in phrases:
        rarest = by_idf(words)[0]
        lead = words.index(rarest)
        starts = F.transform(F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"] == rarest), lambda h: h["i"] - lead)
        starts = F.filter(starts, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(words)) == _literal(words)))
        places.append(F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.cast("bigint").alias("at"), F.lit(1.0).alias("score"))))
    none = F.array().cast("array<struct<label:string,at:bigint,score:double>>")
    held = scanned.select("row", "doc_id", "n_words", F.coalesce(F.concat(*places), none).alias("places")).join(found, "row", "left")
    held = held.select("doc_id", "n_words", "places", F.coalesce("found", none).alias("found"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return held.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        joined(F.transform("places", lambda p: p["label"])).alias("base_labels"),
        joined(F.transform(F.concat("places", "found"), lambda p: p["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("places", "found"), lambda p: p["score"])), F.lit(0.0)).alias("score"),
        F.transform("found", lambda p: F.struct(p["label"].alias("label"), p["at"].alias("word"))).alias("notices"),
    )
