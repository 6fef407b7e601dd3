"""Rows that may meet a set of keys, found where they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (2 MB of words).
FILTER_BITS = 1 << 24


def _flagged(rows: DataFrame, keys: DataFrame, key: str, bits: int, how: str) -> DataFrame:
    """``rows`` (an inner join: those whose word is known) with ``_may``: whether the key may be among ``keys``."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_mask"))
    return (rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", how)
            .withColumn("_may", F.coalesce(F.col("_mask").bitwiseAND(one) != 0, F.lit(False))).drop("_word", "_bit", "_mask"))


def sifted(rows: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """:func:`sift`, and the rows whose ``key`` is surely not among ``keys``."""
    flagged = _flagged(rows, keys, key, bits, "left")
    return flagged.where("_may").drop("_may"), flagged.where("not _may").drop("_may")


def sift(rows: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (one-hash Bloom filter),
    without a shuffle of ``rows``.

    The filter is a table of at most ``bits`` / 64 words of 64 bits, so its
    broadcast is bounded whatever the number of keys; more keys only let more
    rows through to the exact join that has to follow.  A null key counts as
    any other."""
    return _flagged(rows, keys, key, bits, "inner").where("_may").drop("_may")
