import random
import re
import zlib

import zstandard

from marlstone.llm.toxicity import LEVEL, _by_piece, _spread, calibrated, fit, measured, score_toxicity


def sample(n=900):
    rng = random.Random(6)
    syllables = "the of an er in on re th ed nd ha at en es or".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic = i % 5 == 1
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["gribbulous", "wixxant", "Plokkey", "vummidge"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark, docs):
    rows = sample()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    table = docs([t for _, t, _ in rows] + [None, "", "Plokkey", "the of an", "the " * 100_000, "x"], [i for i, _, _ in rows] + [9000, 9001, 9002, 9003, 9004, None])
    got = {r.doc_id: r for r in score_toxicity(table, labels).collect()}
    truth = {i: y for i, _, y in rows}
    own = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(own)) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert [got[i].predicted for i in (9000, 9001, 9002, 9003, 9004, None)] == [0, 0, 1, 0, 0, 0]


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in score_toxicity(docs(["a b", None]), none).collect()] == [0, 0]
    assert score_toxicity(docs([]), none).count() == 0


def test_chances_never_fall():
    chances = calibrated([0, 0, 0, 3, 3, 5, 9], [0, 0, 1, 1, 0, 0, 1])
    assert chances == sorted(chances) and len(chances) == 10


def test_levels_are_differences_of_window_lengths():
    rows = sample(300)
    contents = fit([t.lower().encode() for _, t, y in rows if y], [t.lower().encode() for _, t, y in rows if not y])
    raw = lambda d: zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    toxic, ordinary = (zstandard.ZstdCompressor(level=LEVEL, dict_data=raw(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in contents)
    texts = [t for _, t, _ in rows[:40]] + ["x " * 300_000 + "wixxant", "Wixxant " * 5, "", None, "12 34"]
    expected = []
    for text in texts:
        windows = [(" " + w).encode() * 3 + b" " for w in set(re.findall("[a-z\x80-\uffff]+", (text or "").lower()))]
        expected.append(min(9, max([0] + [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows])))
    assert measured([None if t is None else t.encode() for t in texts], *contents) == expected


def test_repeated_ids_and_sample_bounds(spark, docs):
    rows = sample(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (1, 0), (None, 1)], "doc_id bigint, toxic int")
    table = docs([t for _, t, _ in rows] + ["wixxant"] * 30 + ["of the"] * 3, [i for i, _, _ in rows] + [1] * 30 + [None] * 3)
    got = score_toxicity(table, labels, toxic_rows=20, ordinary_rows=40, sample_bytes=4000).collect()
    assert len(got) == 233 and sum(r.doc_id is None for r in got) == 3
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_pieces_are_counted_by_text():
    """Texts of each piece against plain sets: copies and repeats of a word in the same context count once."""
    texts = [t.lower().encode() for _, t, _ in sample(40)]
    texts += texts[:7] + [b"", b"x", b"the the the", "Straße état".lower().encode(), b"1 2", b"ab" * 3000]
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        words = re.findall(b"[a-z\x80-\xff]+", text)
        for before, word in set(zip([b"", *words], words)) - seen:
            seen.add((before, word))
            framed = b" " + word + b" "
            for piece in {framed[j : j + k] for k in (5, 6, 7) for j in range(len(framed) - k + 1)}:
                expected.setdefault(piece, set()).add(i)
    expected = {p: len(x) for p, x in expected.items()}
    number = lambda p: len(p) << 8 * len(p) | int.from_bytes(p, "big")
    for least, most in ((1, 1 << 21), (3, 5)):
        names, n = _by_piece(_spread(texts), least=least, most=most)
        assert dict(zip(names.tolist(), n.tolist())) == {number(p): x for p, x in expected.items() if x >= least}
    assert not len(_by_piece(_spread([]))[0]) and not len(_by_piece(_spread([b""]))[0])
