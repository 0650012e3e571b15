import re

import pytest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def folded(text):
    return WORD.findall((text or "").translate(FOLD))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, part string, label string"


@pytest.fixture
def docs(spark):
    """Documents from texts, with columns whose names clash with results and inner columns."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture
def sf001():
    return "/root/testdata/sf0.001"
