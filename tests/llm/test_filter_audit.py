from itertools import permutations

import pytest

from marlstone.llm.filter_audit import INDEX, audit, audit_corpus, bitmap_index, survivors

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        fails = (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > first[t],
        )
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((part or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails, name = sum(r[1][f] for r in mine), "".join("ABCDE"[k] for k in order)
                only = sum(r[1][f] and sum(r[1]) == 1 for r in mine)
                out[part, name, step] = [len(left), len(gone), fails - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley["ABCDE"[f]] += len(gone)
        for (p, name, step), v in out.items():
            if p == part:
                v.append(shapley[name[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(220))
    texts = [long, long, long.upper(), "a\x0bb" * 300, "x " * 250, long + " #", None, "", " \n", "Ab cd", "100% of it", long + " tail", "x " * 250, long * 40]
    langs = ["en", None, "", "de", "en"]
    docs = [(i, t, langs[i % 5]) for i, t in enumerate(texts)]
    docs += [(None, long, "en"), (None, None, None), (3, "a\x0bb" * 300, "de"), (3, "x", "de"), (3, "x", "de"), (-5, "100% of it", "fr")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (12, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(i, t, p, "E", 7) for i, t, p in docs], "doc_id bigint, text string, lang string, part string, A int").repartition(4)
    known = spark.createDataFrame([(*x, "en") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = audit_corpus(table, known)
    assert got.columns == ["part", "filter_order", "step", *COLUMNS]
    rows = got.collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows} == brute(docs, labels)
    assert len(rows) == 600 * 4
    assert audit_corpus(table.where("false"), known).count() == 0
    assert audit_corpus(table, known.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_bitsets_of_many_blocks_and_parts(spark):
    rows = [(f"p{i * i % 37}" if i % 11 else None, i % 3 == 0, None if i % 5 == 0 else i % 2 == 0, i % 7 == 0) for i in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
    try:
        index = bitmap_index(spark.createDataFrame(rows, "part string, F boolean, G boolean, L boolean").repartition(3), filters=["F", "G"], labels=["L"])
        found = {(r.part, r.subset): tuple(r.alive) for r in survivors(index, n_filters=2).collect()}
        assert index.count() > 10 and index.schema.simpleString() == spark.createDataFrame([], INDEX).schema.simpleString()
        last = audit(index, filters=["F", "G"], labels=["L"]).where("step = 2 and filter_order = 'GF'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for part in {p for p, *_ in rows}:
        mine = [(bool(f), bool(g), bool(v)) for p, f, g, v in rows if p == part]
        for subset in range(4):
            left = [x for x in mine if not (subset & 1 and x[0] or subset & 2 and x[1])]
            assert found[part or "", subset] == (len(left), sum(x[2] for x in left))
        (row,) = [r for r in last if r.part == (part or "")]
        assert (row.kept, row.removed) == (sum(not f and not g for f, g, _ in mine), sum(f and not g for f, g, _ in mine))


def test_few_filters_only(spark):
    with pytest.raises(ValueError, match="one to eight"):
        audit(spark.createDataFrame([], INDEX), filters=list("ABCDEFGHI"), labels=[])
