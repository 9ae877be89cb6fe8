"""Digests over canonical strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of, without_blanks


def fingerprint(*fields: Column) -> Column:
    """sha256 of the fields' texts with their lengths in front, so that no two lists of fields have one form; null differs from empty."""
    parts = [F.coalesce(F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def text_fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the md5 of a text without blanks."""
    return F.substring(F.md5(without_blanks(text_of(text))), 1, 16)


def embedding_version(provider: Column, model: Column, endpoint: Column) -> Column:
    return F.concat_ws(":", provider, model, F.substring(F.sha2(text_of(endpoint), 256), 1, 16))


def key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), name.cast("string"))


def split_key(value: Column) -> Column:
    """kind and name; a key without a colon has no name."""
    at = F.instr(value, ":")
    return F.struct(F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value).alias("kind"), F.when(at > 0, F.substring(value, at + 1, F.length(value))).otherwise("").alias("name"))
