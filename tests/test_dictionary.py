"""Occurrences of a dictionary in texts against plain searches, and texts without them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import dictionary as d
from quarry.operators import matching


def plain(terms, texts, blanks=True, fold=False):
    """(id, term, start, end) of every place, blanks and case aside if asked for."""

    def form(text):
        at = [i for i, c in enumerate(text) if blanks or not c.isspace()]
        return "".join(c.lower() if fold and len(c.lower()) == 1 else c for c in (text[i] for i in at)), at

    out = set()
    for key, text in texts:
        own, at = form(text or "")
        for term in {t for t in terms if t}:
            wanted = form(term)[0]
            for i in range(len(own) - len(wanted) + 1 if wanted else 0):
                if own.startswith(wanted, i):
                    out.add((key, term, at[i], at[i + len(wanted) - 1] + 1))
    return out


def tables(spark, terms, texts):
    return spark.createDataFrame([(t,) for t in terms], "term string").repartition(3), spark.createDataFrame(texts, "id long, text string").repartition(3)


@pytest.mark.parametrize("blanks, fold", [(True, False), (False, True)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_occurrences(spark, monkeypatch, blanks, fold, broadcast):
    """Random terms of every length over a small alphabet, nulls, empty ones, copies; joined by broadcast and by shuffle."""
    if not broadcast:
        monkeypatch.setattr(d, "MOST_FORMS", 0)
    monkeypatch.setattr(d, "CHARACTERS", 500)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB \n　é漢\U0001f600") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 120))) for i in range(60)] + [(100, None), (101, ""), (102, "ab" * 700), (103, "ab" * 700)]
    terms = [word(n) for n in [1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 12]] + [texts[k][1][a : a + n] for k, a, n in [(1, 3, 9), (2, 0, 17), (3, 5, 40), (4, 1, 70)]] + ["ab" * 40, "ab" * 300, None, "", " ", "ab"]
    found = {tuple(r) for r in d.occurrences(*tables(spark, terms, texts), "id", blanks=blanks, fold=fold).collect()}
    assert found == plain(terms, texts, blanks, fold)
    once = [tuple(r)[:2] for r in d.occurrences(*tables(spark, terms, texts), "id", blanks=blanks, fold=fold, once=True).collect()]
    assert len(once) == len(set(once)) and set(once) == {r[:2] for r in found}


def test_redaction(spark):
    """Overlapping and touching names go wholly, also across blanks and line breaks, in any case."""
    texts = [(1, "甲乙测试企业有限公司"), (2, "甲 乙\n测试企业有限"), (3, "无标识正文"), (4, None), (5, ""), (6, "ACME Corp and acme corp"), (7, "甲乙甲乙"), (8, "乙 甲")]
    names, rows = tables(spark, ["甲乙", "乙测试企业有限", "acme\tCORP", "乙测试", None], texts)
    found = {r.id: (r.text, r.n_hidden) for r in d.redacted(rows, names, "id").collect()}
    m = d.MARK
    assert found == {1: (m + "公司", 1), 2: (m, 1), 3: ("无标识正文", 0), 4: (None, 0), 5: ("", 0), 6: (f"{m} and {m}", 2), 7: (m, 1), 8: ("乙 甲", 0)}
    assert {r.text for r in d.redacted(rows, names.limit(0), "id").collect()} == {t for _, t in texts}


def test_many_names_and_runs(spark):
    """Against a search by one pattern, with two thousand names and a text of many runs."""
    rng = random.Random(5)
    names = [f"name{rng.randrange(10**6)}x" for _ in range(2000)]
    texts = [(i, " ".join(rng.choice(names) if rng.random() < 0.3 else "word" for _ in range(400))) for i in range(20)]
    pattern = re.compile("|".join(sorted(map(re.escape, names), key=len, reverse=True)))
    terms, rows = tables(spark, names, texts)
    found = {r.id: r.text for r in d.redacted(rows, terms, "id", mark="#").collect()}
    assert found == {i: pattern.sub("#", t) for i, t in texts}


def test_longest_first(spark):
    """One inside another that was taken is left out; one that only overlaps stays."""
    terms, rows = tables(spark, ["公司", "某某公司", "张三", "某公"], [(1, "由某 某公司张 三与公司承担")])
    found = d.longest_first(d.occurrences(terms, rows, "id", blanks=False), "id").orderBy("start").collect()
    assert [(r.term, r.start, r.end) for r in found] == [("某某公司", 1, 6), ("张三", 6, 9), ("公司", 10, 12)]


def test_containing(spark):
    rows = spark.createDataFrame([(1, "Title ab", "body cd"), (2, None, "ab"), (3, "", ""), (2, "cd", None)], "id long, title string, body string")
    terms = spark.createDataFrame([("ab",), ("cd",), ("x",), ("zz",)], "term string")
    found = {(r.id, r.term, r.title, r.body) for r in matching.containing(terms, rows, "id", ["title", "body"]).collect()}
    assert found == {(1, "ab", True, False), (1, "cd", False, True), (2, "ab", False, True), (2, "cd", True, False)}


def test_hot_terms_leave_texts_in_place(spark):
    """A term that stands in every text: no exchange of the texts, and no row but for its places."""
    terms, rows = tables(spark, ["hot"], [(i, "a hot day " + "x" * 50) for i in range(500)])
    found = d.occurrences(terms, rows.coalesce(2), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and found.agg(F.count("*")).first()[0] == 500


def test_texts_are_scanned_in_small_lots():
    """Lots hold a stated number of bytes, or one text; lists of places are cut from one array."""
    import numpy as np
    import pyarrow as pa

    from quarry.operators import dictionary

    texts = pa.array(["x" * (dictionary.CHARACTERS // 2 - 1), None, "y", "系统" * dictionary.CHARACTERS, "z"])
    assert list(dictionary.lots(texts)) == [(0, 3), (3, 4), (4, 5)] and list(dictionary.lots(pa.array([], pa.string()))) == []
    assert dictionary.CHARACTERS <= 1 << 18
    found = dictionary.stretches(np.arange(10, 20), np.array([0, 3, 9]), np.array([2, 3, 10]))
    assert found.to_pylist() == [[10, 11], [], [19]]
