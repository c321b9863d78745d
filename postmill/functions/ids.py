"""Derived identities and perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts between bars (null: empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def sign_bits(vector: Column) -> Column:
    """Bit i of a BIGINT: whether element i of a vector (64 at most) is positive."""
    return F.aggregate(
        F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda a, x: a.bitwiseOR(x),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_bits(hex16: Column) -> Column:
    """A 64-bit hash of 16 hex digits as BIGINT, with its sign bit as it is."""
    return F.conv(hex16, 16, -10).cast("bigint")
