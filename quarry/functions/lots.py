"""Columns that Python tells from texts, in lots of bounded size, so that a worker's memory does not follow the batches that Spark hands it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of a lot, and their bytes together (or one longer text).
MOST_TEXTS, MOST_BYTES = 256, 1 << 18


def lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts with at most MOST_TEXTS texts and MOST_BYTES bytes, or one longer text."""
    i, held = 0, 0
    for j, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if j > i and (held + size > MOST_BYTES or j - i == MOST_TEXTS):
            yield i, j
            i, held = j, 0
        held += size
    if len(texts):
        yield i, len(texts)


def by_lots(tell: Callable, kind: str, made: pa.DataType) -> Callable[..., Column]:
    """A function of columns, the first of texts: tell(value, ...) for each row. kind and made: the type of what it tells, for Spark and for Arrow."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for i, j in lots(columns[0]):
                yield pa.array(map(tell, *[c.slice(i, j - i).to_pylist() for c in columns]), made)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((column,) for column in batches)

    one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else run, kind)(*columns)


def blanked(*forms: str) -> Callable[[str | None], str]:
    """A function of a text: the text with all that matches blank, its length and its lines as they were."""
    patterns = [re.compile(form.replace(r"\z", r"\Z")) for form in forms]

    def run(text: str | None) -> str:
        text = text or ""
        for pattern in patterns:
            text = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        return text

    return run
