"""Differences of versions against plain alignments."""

import random

import pytest

from quarry.operators import diffs as d


def longest(a, b):
    """Length of a longest common subsequence, by the plain table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def own_lines(text):
    out = (text or "").split("\n")
    return out[:-1] if out[-1] == "" else out


@pytest.mark.parametrize("cells", [d.MOST_CELLS, 6])
def test_common(monkeypatch, cells):
    """A longest common subsequence with ties and empty sides, also when it is cut in two again and again."""
    monkeypatch.setattr(d, "MOST_CELLS", cells)
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        found = d.common(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_increasing():
    rng = random.Random(2)
    for _ in range(300):
        js = rng.sample(range(30), rng.randrange(12))
        found = d.increasing(list(enumerate(js)))
        assert [j for _, j in found] == sorted(j for _, j in found) and len(found) == longest(js, sorted(js))


def versions(seed, n):
    """Pairs with unique lines, repeated lines, moved blocks, empty sides, changed lines and missing last line feeds."""
    rng = random.Random(seed)
    out = [(0, None, None), (1, "", "a\nb"), (2, "a\nb\n", ""), (3, "same\n", "same"), (4, "x\nx\nx", "x\nx"), (5, "a\nb\nc\nd", "c\nd\na\nb"), (6, "\n\n", "\n")]
    for k in range(n):
        words = [f"line {i} {'abcdefg'[i % 7] * 5}" for i in range(rng.randrange(1, 25))] + ["repeated"] * rng.randrange(4) + [""] * rng.randrange(3)
        rng.shuffle(words)
        new = [w if rng.random() < 0.7 else rng.choice([w + " more", w[::-1], "new text", "repeated"]) for w in words if rng.random() < 0.85]
        if rng.random() < 0.3:
            new = new[len(new) // 2 :] + new[: len(new) // 2]
        out.append((10 + k, "\n".join(words) + "\n" * rng.randrange(2), "\n".join(new)))
    return out


def shown(spark, pairs):
    rows = spark.createDataFrame([(k, "key", a, b) for k, a, b in pairs], "id long, kind string, before string, after string").repartition(4)
    out = {}
    for r in d.text_diff(rows, ["id", "kind"], "before", "after").collect():
        out.setdefault(r.id, []).append(r)
    return {k: sorted(v, key=lambda r: r.pos) for k, v in out.items()}


def test_text_diff(spark):
    pairs = versions(3, 150)
    found = shown(spark, pairs)
    for key, old, new in pairs:
        rows, a, b = found.get(key, []), own_lines(old), own_lines(new)
        assert [r.pos for r in rows] == list(range(len(rows)))
        side = lambda kind: ["".join(p.text for p in r.parts if p.type in ("same", kind)) if r.type == "mod" else r.text for r in rows if r.type in ("same", "mod", kind)]  # noqa: B023, E731
        assert side("del") == a and side("add") == b  # both versions can be read off
        same = sum(r.type == "same" for r in rows)
        anchors = sorted((a.index(x), b.index(x)) for x in set(a) & set(b) if a.count(x) == b.count(x) == 1)
        js = [j for _, j in anchors]
        assert longest(js, sorted(js)) <= same <= longest(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert same == longest(a, b)
        for r in rows:
            if r.type == "mod":
                kept = sum(len(p.text) for p in r.parts if p.type == "same")
                left, right = ("".join(p.text for p in r.parts if p.type in ("same", s)) for s in ("del", "add"))
                assert kept == longest(left, right) and kept >= d.INLINE_SHARE * max(len(left), len(right))
        for x, y in zip(rows, rows[1:], strict=False):
            if (x.type, y.type) == ("del", "add"):
                assert longest(x.text, y.text) < d.INLINE_SHARE * max(len(x.text), len(y.text))


def test_diff_by_hand(spark):
    old, new = "head\nold one\nkeep\ngone\nend", "head\nnew one\nkeep\nend\n完全不同"
    rows = shown(spark, [(1, old, new)])[1]
    assert [(r.type, r.text) for r in rows] == [("same", "head"), ("mod", None), ("same", "keep"), ("del", "gone"), ("same", "end"), ("add", "完全不同")]
    assert [tuple(p) for p in rows[1].parts] == [("del", "old"), ("add", "new"), ("same", " one")]
    table = spark.createDataFrame([(1, old, new), (2, "a", "a")], "id long, a string, b string")
    stats = {r.id: (r.added, r.removed, r.changed) for r in d.diff_stats(d.text_diff(table, ["id"], "a", "b"), ["id"]).collect()}
    assert stats == {1: (7, 7, True), 2: (0, 0, False)}


def test_edit_ratios(spark):
    """Equal but for line feeds and blanks at ends: 0. Replaced text counts once, the longer side."""
    rows = [(1, "a b  \r\nc\n", "a b\nc"), (2, "abcdef", "abXYef"), (3, "one\ntwo\nthree", "one\nthree"), (4, None, "xyz"), (5, "xyz", ""), (6, "aaaaaaaa\nkeep", "bbbb\nkeep"), (7, None, None), (8, "abc", "abcd")]
    table = spark.createDataFrame(rows, "id long, a string, b string")
    found = {r.id: (r.edited, round(r.ratio, 4)) for r in d.edit_ratios(table, ["id"], "a", "b").collect()}
    assert found == {1: (0, 0.0), 2: (2, 0.3333), 3: (4, 0.3077), 4: (4, 4.0), 5: (4, 1.3333), 6: (9, 0.6923), 7: (0, 0.0), 8: (1, 0.3333)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_are_aligned_where_they_are(spark):
    """Two versions stand in one row: no line is shuffled, and statistics are summed before they are."""
    pairs = spark.range(3).selectExpr("id", "concat('a\nb', id) AS a", "'b1' AS b")
    assert "Exchange" not in plan_of(d.text_diff(pairs, ["id"], "a", "b"))
    assert plan_of(d.diff_stats(d.text_diff(pairs, ["id"], "a", "b"), ["id"])).count("Exchange") == 1


def test_rows_of_many_versions_in_small_lots(spark, monkeypatch):
    monkeypatch.setattr(d, "CHARACTERS", 10)
    test_text_diff(spark)


def test_edit_ratios_join_no_text_back(spark):
    """Texts are put into their normal form for the alignment alone; what is joined back is their size."""
    pairs = spark.range(3).selectExpr("id", "concat('a\nb', id) AS a", "'b1' AS b")
    assert plan_of(d.edit_ratios(pairs, ["id"], "a", "b")).count("AS _old#") == 1
