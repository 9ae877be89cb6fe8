"""Chunks of documents for retrieval: a fold over the paragraphs of each document, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Sizes in characters, and where a long paragraph may be cut.
TARGET, MOST, LEAST = 500, 1000, 100
SENTENCE = re.compile(r"(?<=[。；！？.;!?\n])")


def packed(parts: list[str], target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[str]:
    """Paragraphs packed into chunks: one is closed when the next paragraph would pass the target and it has the least size.

    A paragraph above `most` is cut at sentences, which are packed by themselves. A last small chunk joins the one before.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close(glue: str) -> None:
        nonlocal held, size
        if text := glue.join(held).strip():
            out.append(text)
        held, size = [], 0

    for part in parts:
        if size + len(part) > target and size >= least:
            close("\n")
        if len(part) <= most:
            held.append(part)
            size += len(part)
            continue
        close("\n")
        for sentence in SENTENCE.split(part):
            if held and size + len(sentence) > target:
                close("")
            held.append(sentence)
            size += len(sentence)
        close("")
    close("\n")
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) < most:
        out[-2:] = [f"{out[-2]}\n{out[-1]}"]
    return out


def chunked(docs: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """doc_id, seq and content of every chunk; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if isinstance(t, str) for i, c in enumerate(packed([p for p in t.split("\n") if p.strip()], target, most, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, seq int, content string")
