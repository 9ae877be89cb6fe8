import random

import pytest

WORDS = [a + b for a in "ba ke li mo nu ra si to ve za".split() for b in ["n", "r", "l", "st", "m", ""]]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): nulls, empty texts, copies, near copies, shared passages, ties, odd characters and a very long text."""
    base, shared = prose(1, 200), prose(2, 60)
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "  ")), (4, base + " one more word"), (5, None), (6, ""), (7, "   \n\t "), (8, "word"), (9, "word"), (10, "Two words"),
        (11, shared + " " + prose(3, 50)), (12, prose(4, 50) + "\n" + shared), (13, (prose(5, 25) + " ") * 4), (14, "é" * 120 + " " + "\U0001f600 ß İ Σας ΟΔΟΣ"), (15, prose(6, 40_000)),
        (16, prose(7, 30) + " " + prose(6, 500)), (17, "a" * 300), (18, "a" * 299), (19, "<|endoftext|> it's 12,3 a\x1cb x"), (20, "word, Word. WORD!! ok?!"), (21, base[:-3]),
    ]
    return rows


CLASHING = "lang string, source string, n_chars long, label string, score double, row int, rank int, digest string, body string, bucket int, block long, rep long, cluster long, `_place` double, `_n` long, text_sha string, spans string, saved string"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The same as a table with further columns, all null, whose names the operators use inside."""
    n = len(CLASHING.split(","))
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in odd_texts], f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def nameless(spark):
    """Rows without identifier and rows that repeat one."""
    rows = [(None, "same text here"), (None, "same text here"), (4, "same text here"), (4, "same text here"), (4, None), (None, None), (3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
