"""Differences of two versions of texts: lines that correspond, changed lines told apart within, and how much was edited.

Of lines that stand once on either side the longest chain that keeps both orders anchors the alignment, and only lines
between two anchors are aligned with each other. Two versions stand in one row, so they are aligned where they are, without a
shuffle; a task holds a batch of rows, and what comes of some of them. Statistics of a pair are sums over its rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, text_of, without_blanks

# Fixed value: a pair of lines with a smaller common share is shown as one taken away and one put in.
INLINE_SHARE = 0.3
#: Cells of an alignment that are held at once, a bit each; larger ones are cut in two first.
MOST_CELLS = 1 << 30
#: Characters of texts whose rows are handed on at once.
CHARACTERS = 1 << 20
PARTS = "array<struct<type:string,text:string>>"
ARROW_PARTS = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both numbers (pairs sorted by the first); the later ones end smaller."""
    ends, at, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(ends, j)
        before[k] = at[place - 1] if place else -1
        ends[place : place + 1], at[place : place + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def rows_of_bits(a: Sequence, b: Sequence) -> list[int]:
    """For each item of b, bits over a: a zero where the longest common subsequence so far grows by that item of a."""
    places: dict[object, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    mask, row, out = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & mask
        out.append(row)
    return out


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, of equal beginnings and ends first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    inner: list[tuple[int, int]] = []
    if len(x) * len(y) > MOST_CELLS and len(y) > 1:
        half = len(y) // 2
        left, right = rows_of_bits(x, y[:half])[-1], rows_of_bits(x[::-1], y[half:][::-1])[-1]
        grown = [0]
        for k in range(len(x)):
            grown.append(grown[-1] + (not left >> k & 1))
        best, gained = (grown[-1], len(x)), 0
        for k in range(len(x)):
            gained += not right >> k & 1
            best = max(best, (grown[len(x) - 1 - k] + gained, len(x) - 1 - k))
        cut = best[1]
        inner = common(x[:cut], y[:half]) + [(i + cut, j + half) for i, j in common(x[cut:], y[half:])]
    elif len(x) and len(y):
        table, i, j = rows_of_bits(x, y), len(x), len(y)
        while i and j:
            if table[j - 1] >> (i - 1) & 1:
                i -= 1
                continue
            j -= 1
            if not j or table[j - 1] >> (i - 1) & 1:
                i -= 1
                inner.append((i, j))
        inner.reverse()
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in inner] + ends


def line_parts(old: str, new: str, least: float) -> list[tuple[str, str]] | None:
    """A changed line as parts same, del and add; None if less than `least` of the longer one is common."""
    met = common(old, new)
    if len(met) / max(len(old), len(new), 1) < least:
        return None
    out: list[list[str]] = []

    def put(kind: str, text: str) -> None:
        if text and out and out[-1][0] == kind:
            out[-1][1] += text
        elif text:
            out.append([kind, text])

    i = j = 0
    for p, q in [*met, (len(old), len(new))]:
        put("del", old[i:p])
        put("add", new[j:q])
        put("same", old[p : p + 1])
        i, j = p + 1, q + 1
    return [(kind, text) for kind, text in out]


def own_lines(text: str | None) -> list[str]:
    """Lines without the empty one after a last line feed; an empty text has none."""
    all_lines = (text or "").split("\n")
    return all_lines if all_lines[-1] else all_lines[:-1]


def matched(old: list[str], new: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j) of lines that correspond, rising in both."""
    n, m = Counter(old), Counter(new)
    place = {line: j for j, line in enumerate(new)}
    anchors = increasing([(i, place[line]) for i, line in enumerate(old) if n[line] == 1 and m[line] == 1])
    i = j = 0
    for p, q in [*anchors, (len(old), len(new))]:
        yield from ((i + x, j + y) for x, y in common(old[i:p], new[j:q]))
        if p < len(old):
            yield p, q
        i, j = p + 1, q + 1


def rows_of(old: list[str], new: list[str]) -> Iterator[tuple[str, str | None, list[tuple[str, str]] | None]]:
    """Rows (type, text, parts) of two versions, in order."""
    i = j = 0
    for p, q in [*matched(old, new), (len(old), len(new))]:
        for x, y in zip_longest(old[i:p], new[j:q]):
            parts = line_parts(x, y, INLINE_SHARE) if x is not None and y is not None else None
            if parts is not None:
                yield "mod", None, parts
                continue
            if x is not None:
                yield "del", x, None
            if y is not None:
                yield "add", y, None
        if p < len(old):
            yield "same", old[p], None
        i, j = p + 1, q + 1


def text_diff(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, pos, type, text, parts): lines that are the same, taken away (del), put in (add) or changed (mod, with its parts).

    Between two lines that are the same, the k-th line taken away and the k-th put in are one changed line if they have enough
    in common, else both, the old one first. Null is an empty text, which has no lines; two versions without lines have no
    row. keys name one pair and are not null. A line is compared without its line feed. Rows are handed on as they come.
    """
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, of, held, out = batch.select(range(len(keys))), [], 0, []

            def told() -> pa.RecordBatch:
                taken = [c.take(pa.array(of, pa.int64())) for c in own.columns]  # noqa: B023
                pos, rows = ([r[k] for r in out] for k in (0, 1))  # noqa: B023
                parts = [None if r[2] is None else [{"type": k, "text": t} for k, t in r[2]] for r in rows]
                return pa.RecordBatch.from_arrays([*taken, pa.array(pos, pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(parts, ARROW_PARTS)], [*keys, "pos", "type", "text", "parts"])

            for k in range(batch.num_rows):
                a, b = (batch.column(len(keys) + side)[k].as_py() for side in (0, 1))
                for pos, row in enumerate(rows_of(own_lines(a), own_lines(b))):
                    of.append(k)
                    out.append((pos, row))
                held += len(a or "") + len(b or "")
                if held >= CHARACTERS:
                    yield told()
                    of, held, out = [], 0, []
            yield told()

    return pairs.select(*keys, old, new).mapInArrow(run, f"{kinds}, pos int, type string, text string, parts {PARTS}")


def diff_stats(diff: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed, changed): characters put in and taken away, blanks aside, and whether any line is not the same."""
    sized = lambda kind: F.length(without_blanks(F.concat_ws("", F.when(F.col("type") == kind, F.col("text")), F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == kind), lambda p: p["text"]), ""))))
    return diff.groupBy(*keys).agg(F.sum(sized("add")).alias("added"), F.sum(sized("del")).alias("removed"), F.bool_or(F.col("type") != "same").alias("changed"))


def normalised(text: Column) -> Column:
    """A text as it is compared for edits: one kind of line feed, no blanks at the ends of lines and of the text."""
    even = F.regexp_replace(text_of(text), "\r\n", "\n")
    return stripped(F.regexp_replace(even, r"(?m)[^\S\n]+$", ""))


def edit_ratios(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, edited, ratio): characters that were put in, taken away or replaced, and their share of the old text's characters.

    Texts are compared in their normalised form, line by line and within changed lines; where something is taken away and
    something put in at one place, the longer of the two counts, and a line without a partner counts with its line feed. Equal
    versions have 0; an empty old text counts as one character.
    """
    even = pairs.select(*keys, normalised(F.col(old)).alias("_old"), normalised(F.col(new)).alias("_new"))
    # Parts in order: a part put in right after one taken away replaces it.
    size = lambda p: F.length(p["text"])
    within = F.aggregate(
        "parts", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("gone")),
        lambda s, p: F.when(p["type"] == "del", F.struct((s["sum"] + size(p)).alias("sum"), size(p).alias("gone"))).when(p["type"] == "add", F.struct((s["sum"] + F.greatest(size(p) - s["gone"], F.lit(0))).alias("sum"), F.lit(0).alias("gone"))).otherwise(F.struct(s["sum"].alias("sum"), F.lit(0).alias("gone"))),
        lambda s: s["sum"],
    )
    edited = F.when(F.col("type") == "mod", within).when(F.col("type") == "same", 0).otherwise(F.length("text") + 1)
    rows = text_diff(even, keys, "_old", "_new").withColumn("_n", edited)
    # A line taken away and the one put in beside it, too different to be one changed line, replace each other.
    along = Window.partitionBy(*keys).orderBy("pos")
    beside = (F.col("type") == "add") & (F.lag("type").over(along) == "del")
    rows = rows.withColumn("_n", F.when(beside, F.greatest(F.col("_n") - F.lag("_n").over(along), F.lit(0))).otherwise(F.col("_n")))
    sums = rows.groupBy(*keys).agg(F.sum("_n").alias("_sum"))
    sizes = pairs.select(*keys, F.length(normalised(F.col(old))).alias("_size"))  # no text is joined back
    found = sizes.join(sums, keys, "left").withColumn("edited", F.coalesce("_sum", F.lit(0)).cast("long"))
    return found.select(*keys, "edited", (F.col("edited") / F.greatest(F.col("_size"), F.lit(1))).alias("ratio"))
