"""Quality rules by host against plain loops."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_rules as q

from ..harness import differences
from .conftest import prose


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


ODD = ["a b c a b c a b c", "x y x y x y x y", "a b c d é#*$%&|<>", "l one\nl one\n \nl one\n\r\n\t", "a\x0bb\x0cc\rd", "\x00 \x00 \x00 \x00", "w " * 300]


def rows_of(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


@pytest.mark.parametrize("bits", [q.PLACE_BITS, 58, 3])
def test_texts(spark, odd_docs, odd_texts, monkeypatch, bits):
    """58 bits for places leave hashes that clash; 3 bits are too few for places: both sort texts instead."""
    monkeypatch.setattr(q, "PLACE_BITS", bits)
    more = [(100 + i, t) for i, t in enumerate(ODD)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    assert rows_of(q.text_rules(docs)) == {i: plain(t) for i, t in [*odd_texts, *more]}


def test_hosts(spark):
    """A large host of short texts fails, so its long text goes; a small one of short texts does not; null hosts are judged by text."""
    rows = [(i, "short", "junk") for i in range(200)] + [(1000, prose(1, 80), "junk"), (1001, prose(2, 80), "small"), (1002, "short", "small"), (1003, prose(3, 80), None), (1004, None, None)]
    rows += [(2000 + i, prose(i, 60 + i % 3), f"h{i % 20}") for i in range(400)]
    docs = spark.createDataFrame([(a, b, c, "x", True) for a, b, c in rows], "doc_id long, text string, site string, host string, kept boolean").repartition(5)
    found = {r.doc_id: r for r in q.quality_rules(docs, host=F.col("site")).collect()}
    assert len(found) == len(rows)
    assert not found[1000].base_failed and found[1000].host_failed and not found[1000].kept
    assert found[1001].kept and not found[1002].kept and found[1003].kept and not found[1004].kept
    assert all(found[i].kept for i in range(2000, 2400))


def test_shrinking(spark):
    """Rates by the closed form; alike hosts give the strongest prior."""
    counts = {"a": (30, 3), "b": (10, 9), "c": (60, 20), "d": (4, 0)}
    rows = [(h, i < f, False, False, False) for h, (n, f) in counts.items() for i in range(n)]
    rules = spark.createDataFrame(rows, "host string, short boolean, repeated boolean, symbols boolean, copied_lines boolean")
    total, failing, k = sum(n for n, _ in counts.values()), sum(f for _, f in counts.values()), len(counts) - 1
    p = failing / total
    spread = sum((f - p * n) ** 2 / n for n, f in counts.values())
    rho = (spread / (p * (1 - p)) - k) / (total - sum(n * n for n, _ in counts.values()) / total - k)
    m = 1 / rho - 1
    found = {r.host: r for r in q.host_verdicts(rules).collect()}
    for h, (n, f) in counts.items():
        assert found[h].short_rate == pytest.approx((f + p * m) / (n + m)) and found[h].repeated_rate == 0 and found[h].host_failed == (h == "b")


def test_edges(spark, no_docs, nameless):
    assert q.quality_rules(no_docs, host=F.col("source")).count() == 0
    found = q.quality_rules(nameless).collect()
    assert len(found) == 7 and all(r.base_failed and not r.kept for r in found)


def test_domain(spark):
    rows = spark.createDataFrame([("https://www.Example.org/a?b",), ("http://a.b:80/",), ("no url",), (None,)], "url string")
    assert [r.d for r in rows.select(q.domain(F.col("url")).alias("d")).collect()] == ["example.org", "a.b", None, None]


def test_sql(spark, sf_dir):
    assert differences(q.op13_quality_rules(spark, sf_dir), sf_dir, q.OP13_SQL) is None
