"""Joins of the review model: enrichment, referential filter, corpus rows, fixed domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import BROADCAST_ROWS, join_lookup, small_side


def enrich(
    rows: DataFrame, entities: DataFrame, key: str, columns: Sequence[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add entity columns to every row; rows of unknown entities keep nulls."""
    return join_lookup(rows, entities.select(key, *columns), [key], "left", max_rows)


def drop_orphans(
    rows: DataFrame, entities: DataFrame, key: str, name_col: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows whose entity exists and has a name."""
    named = entities.filter(F.col(name_col).isNotNull()).select(key).distinct()
    return join_lookup(rows, named, [key], "left_semi", max_rows)


def without_listed(rows: DataFrame, column: str, words: DataFrame, word_col: str = "word") -> DataFrame:
    """Rows whose value, in lower case, is not in a one-column word table."""
    listed = small_side(words.select(F.col(word_col).alias("__listed")).distinct())
    return rows.join(listed, F.lower(F.col(column)) == F.col("__listed"), "left_anti")


def corpus_rows(
    reviews: DataFrame, entities: DataFrame, entity: str, variant: str | None, attributes: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per (entity, variant) seen in the reviews, with the entity's attributes.

    Distinct before the join: the fan-out to one row per review never happens.
    """
    keys = [entity] if variant is None else [entity, variant]
    pairs = reviews.filter(F.col(entity).isNotNull()).select(*keys).distinct()
    return join_lookup(pairs, entities.select(entity, *attributes), [entity], "left", max_rows)


def zero_fill(counts: DataFrame, key: str, count: str, low: int, high: int) -> DataFrame:
    """Add the keys of ``low..high`` that have no row, with count 0; other keys stay."""
    domain = counts.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(key))
    return (
        domain.join(counts.withColumn(key, F.col(key).cast("int")), key, "full_outer")
        .select(key, F.coalesce(F.col(count), F.lit(0).cast("long")).alias(count))
    )


def against_average(
    row: DataFrame, table: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Long form ``(keep.., criteria, value, average)``: one row's columns next to the table's means.

    The means are a scalar subquery of the whole table.
    """
    means = table.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("__means"))
    placed = row.select(*keep, *columns, means.scalar().alias("__means"))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("criteria"), F.col(c).cast("double").alias("value"), F.col(f"__means.{c}").alias("average"))
        for c in columns
    ])
    return placed.select(*keep, F.inline(pairs))
