"""Seeded keys: the same digest in every engine, on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *parts: Column) -> Column:
    """md5 over seed and key parts; replaces a sequential random generator."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def hash_number(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def seeded_number(seed: int | str, *parts: Column) -> Column:
    return hash_number(seeded_key(seed, *parts))


def gram_key(text: Column) -> Column:
    """A 16-byte key for long text, to keep shuffles of n-grams narrow."""
    return F.unhex(F.md5(text.cast("binary")))
