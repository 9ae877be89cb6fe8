"""Piece tables against plain replacement; places mapped both ways; changes withdrawn."""

import random

from quarry.operators import pieces


def plain(text, changes):
    """[(start, end, change_id or None, text)] from left to right, the longer and then the smaller change first at a place."""
    out, i, kept = [], 0, 0
    while i < len(text):
        fit = sorted((-len(o), k, o, t) for k, o, t in changes if o and o != t and text.startswith(o, i))
        if not fit:
            i += 1
            continue
        _, k, o, t = fit[0]
        if kept < i:
            out.append((kept, i, None, None))
        out.append((i, i + len(o), k, t or pieces.REVOKED))
        i = kept = i + len(o)
    if kept < len(text):
        out.append((kept, len(text), None, None))
    return out


def texts_of(text, parts):
    return "".join(text[a:b] if k is None else t for a, b, k, t in parts)


def tables(spark, texts, changes):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(changes, "change_id long, original string, text string")


def test_pieces(spark):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))) for i in range(80)] + [(1000, None), (1001, "ab" * 500)]
    changes = [(1, "ab", "X"), (2, "abc", "longer text"), (3, "bc", ""), (4, "cd", None), (5, "d", "d"), (6, "", "never"), (7, None, "never"), (8, "ab", "loses"), (9, "aba", "")]
    docs, asked = tables(spark, texts, changes)
    found = pieces.pieces_of(docs, asked)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.end, r.change_id, r.text))
    wanted = {i: x for i, t in texts if (x := plain(t or "", changes))}
    assert {i: sorted(x) for i, x in rows.items()} == wanted
    now = {r.doc_id: r.text for r in pieces.text_now(found, docs).collect()}
    assert now == {i: None if t is None else texts_of(t, wanted.get(i, [])) for i, t in texts}
    # Places that stand in kept pieces come back to where they were, and hold the same character.
    text_by = dict(texts)
    places = spark.createDataFrame([(i, k) for i, t in texts[:40] for k in range(len(t) + 2)], "doc_id long, place long")
    moved = {(r.doc_id, r.place): r.now for r in pieces.to_new(places, found).collect()}
    for (i, k), at in moved.items():
        kept = any(a <= k < b and c is None for a, b, c, _ in wanted.get(i, []))
        assert (at is not None) == kept and (at is None or now[i][at] == text_by[i][k])
    back = spark.createDataFrame([(i, at) for (i, _), at in moved.items() if at is not None], "doc_id long, place long")
    assert {(r.doc_id, r.place): r.was for r in pieces.to_old(back, found).collect()} == {(i, at): k for (i, k), at in moved.items() if at is not None}
    gone = pieces.withdrawn(found, asked.filter("change_id IN (1, 2)"))
    undone = {i: [(a, b, None if c in (1, 2) else c, None if c in (1, 2) else t) for a, b, c, t in x] for i, x in wanted.items()}
    assert {r.doc_id: r.text for r in pieces.text_now(gone, docs).collect()} == {i: None if t is None else texts_of(t, undone.get(i, [])) for i, t in texts}


def test_confirmed_and_withdrawn(spark):
    """An addendum replaces a clause, a revoked one leaves its mark, and withdrawing brings the original back."""
    docs, asked = tables(spark, [(1, "工期90日历天\n提供驻场服务")], [(1, "提供驻场服务", "改为远程服务"), (2, "工期90日历天", "")])
    found = pieces.pieces_of(docs, asked)
    read = lambda p: pieces.text_now(p, docs).first()["text"]
    assert read(found) == pieces.REVOKED + "\n改为远程服务"
    assert read(pieces.withdrawn(found, asked.filter("change_id = 1"))) == pieces.REVOKED + "\n提供驻场服务"
    assert read(pieces.withdrawn(pieces.withdrawn(found, asked.filter("change_id = 1")), asked)) == "工期90日历天\n提供驻场服务"


def test_places_search_texts_once(spark):
    """The longest piece is looked for in pieces that were written, not by searching the texts again."""
    from quarry.operators import pieces

    docs, calls = spark.createDataFrame([(1, "a the end")], "doc_id int, text string"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    kept = pieces.placed(docs.mapInArrow(seen, docs.schema).selectExpr("doc_id", "0L AS start", "9L AS end", "CAST(NULL AS INT) AS change_id", "CAST(NULL AS STRING) AS text"), "doc_id")
    assert [r.now for r in pieces.to_new(docs.selectExpr("doc_id", "8L AS place"), kept).collect()] == [8]
    assert calls.value == 1
