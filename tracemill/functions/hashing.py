"""Deterministic fractions and picks out of hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(key: Column) -> Column:
    """The first 32 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def fraction(key: Column) -> Column:
    """In [0, 1)."""
    return head(key) / F.lit(4294967296.0)


def pick(key: Column, count: Column) -> Column:
    """A number below count."""
    return head(key) % count


def held_out(id_: Column, share: float = 0.2, seed: int = 0) -> Column:
    """T4: the key is seed:id."""
    return fraction(F.concat_ws(":", F.lit(seed), id_)) < share
