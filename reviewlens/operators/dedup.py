"""Duplicates by key. Which row counts as first is always an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.plans.sizing import join_lookup_null_safe


def _digest(key: Sequence[str]) -> Column:
    # Length marks keep ("a", "bc") and ("ab", "c") apart, and null apart from empty text.
    parts = [F.coalesce(F.concat_ws(":", F.length(c), c), F.lit("")) for c in (F.col(k).cast("string") for k in key)]
    marked = [F.when(F.col(k).isNull(), F.lit("-")).otherwise(p) for k, p in zip(key, parts)]
    return F.unhex(F.sha2(F.concat_ws("|", *marked), 256))


def _keyed(df: DataFrame, key: Sequence[str], digest: bool) -> tuple[DataFrame, list[str]]:
    """The table and the columns to compare: the key itself, or one 32-byte digest of it."""
    return (df.withColumn("__key", _digest(key)), ["__key"]) if digest else (df, list(key))


def keep_first(
    df: DataFrame, key: Sequence[str], order_by: Sequence[str | Column], digest: bool = False
) -> DataFrame:
    """One row per key, the first in ``order_by``; nulls in the key equal each other.

    ``digest`` compares SHA-256 digests of the key, which keeps long texts out of the sort. Planned with a group limit ahead of the shuffle, so each task sends one row per key at most
    and a key with very many copies costs no more than a rare one.
    """
    keyed, columns = _keyed(df, key, digest)
    rank = F.row_number().over(W.partitionBy(*columns).orderBy(*order_by))
    return keyed.withColumn("__rank", rank).filter(F.col("__rank") == 1).select(*df.columns)


def repeated_rows(df: DataFrame, key: Sequence[str], order_by: Sequence[str], digest: bool = False) -> DataFrame:
    """All rows but the first of each key. ``order_by`` must tell rows of one key apart.

    The first row per key is found by a pre-aggregated minimum and joined back, so no task has to
    sort all copies of a key. With ``digest`` only digests of the key are grouped and joined.
    """
    keyed, columns = _keyed(df, key, digest)
    place = F.struct(*order_by)
    firsts = (
        keyed.groupBy(*columns).agg(F.min(place).alias("__first"), F.count("*").alias("__copies"))
        .filter(F.col("__copies") > 1).drop("__copies")
    )
    joined = join_lookup_null_safe(keyed, firsts, columns, "inner", derived=True)
    return joined.filter(place != F.col("__first")).select(*df.columns)


def repeated_count(df: DataFrame, key: Sequence[str], digest: bool = False) -> DataFrame:
    """One row: how many rows repeat an earlier key."""
    keyed, columns = _keyed(df, key, digest)
    per_key = keyed.groupBy(*columns).agg(F.count("*").alias("__copies"))
    return per_key.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("repeated"))
