import random

from marlstone.llm.decontaminate import contaminated_spans

from .conftest import folded


def expected(text, items, window=10):
    words, hit, found = folded(text), set(), set()
    for item, t in items:
        w = folded(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_windows(spark, docs):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcd") + str(rng.randint(0, 2)) for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 25, 40, 1])]
    items += [(90, None), (91, "... !"), (92, items[4][1]), (93, "Éa B-c")]
    texts = [None, "", "éa Éa b c", "x" * 100_000]
    for _ in range(40):
        piece = rng.choice(items)[1] or ""
        words = piece.split()
        a = rng.randint(0, len(words))
        texts.append(" ".join([rng.choice("abcd") + "0", *words[a:], "z,", *words[: a + 3], "Q"]).upper())
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, n_words string, items int")
    for size in (1 << 20, 60):
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in contaminated_spans(docs(texts), bench, block_bytes=size).collect()}
        assert got == {i: expected(t, items) for i, t in enumerate(texts)}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated_spans(docs([]), none).count() == 0
    assert [(r.n_words, r.n_hit) for r in contaminated_spans(docs(["a b"]), none).collect()] == [(2, 0)]
