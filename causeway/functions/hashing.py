"""Deterministic selection by SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest unsigned 64-bit integer; exact as a decimal, 2**64 as a double.
TOP = 2**64 - 1


def hash_u64(text: Column, word: int = 0) -> Column:
    """Unsigned little-endian integer of 8 digest bytes from byte ``8 * word``, as DECIMAL(20, 0)."""
    digest = F.sha2(text.cast("string"), 256)
    pairs = [F.substring(digest, 16 * word + 2 * k + 1, 2) for k in range(7, -1, -1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)")


def bucket(text: Column, buckets: int) -> Column:
    return (hash_u64(text) % buckets).cast("int")


def unit(text: Column, word: int = 0) -> Column:
    """The hash scaled into 0 to 1."""
    return hash_u64(text, word).cast("double") / F.lit(float(TOP))


def ranked(df: DataFrame, key: Column, *, within: list[str] | None = None, tie: list[str], name: str = "hash_rank") -> DataFrame:
    """Rank rows by the hex digest of ``key``, then by ``tie``; hex order is byte order."""
    own = W.partitionBy(*(within or [F.lit(1)])).orderBy(F.sha2(key.cast("string"), 256), *tie)
    return df.withColumn(name, F.row_number().over(own))


def first_by_hash(df: DataFrame, key: Column, count: int, *, within: list[str], tie: list[str]) -> DataFrame:
    """The first ``count`` rows of each group in hash order; larger counts contain smaller ones."""
    return ranked(df, key, within=within, tie=tie).filter(F.col("hash_rank") <= count)
