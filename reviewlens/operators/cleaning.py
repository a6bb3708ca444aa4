"""Projection, null handling, number cleaning and table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.cleaning import DIRTY_TOKENS, clean_number, name_matches, strip


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim column names and turn inner spaces into underscores."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep ``columns``, in that order."""
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove ``columns``."""
    return df.drop(*columns)


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace null by a value per column."""
    return df.fillna(dict(values))


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove rows with a null in any of ``columns``."""
    return df.dropna(subset=list(columns))


def clean_numbers(
    df: DataFrame, columns: Sequence[str], dirty: Sequence[str] = DIRTY_TOKENS, strict: bool = False
) -> DataFrame:
    """Turn text columns with dirty tokens and decimal commas into doubles."""
    return df.withColumns({c: clean_number(F.col(c), dirty, strict) for c in columns})


def find_entities(
    df: DataFrame, id_col: str, name_col: str, keyword: str | None = None, entity_id: object | None = None,
    literal: bool = False,
) -> DataFrame:
    """Rows of one entity: by id if given, else by keyword in the name.

    No match is an empty result; giving neither is an error.
    """
    if entity_id is not None:
        return df.filter(F.col(id_col) == F.lit(entity_id))
    if keyword is not None:
        return df.filter(name_matches(F.col(name_col), keyword, literal))
    raise ValueError("give a keyword or an entity id")


def first_row(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """First row in the given order (planned as top-1, not as a full sort)."""
    return df.orderBy(*order_by).limit(1)


def preview(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows, the first ones in an order if one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def dirty_token_scan(df: DataFrame, dirty: Sequence[str] = DIRTY_TOKENS) -> DataFrame:
    """Rows ``(column, tokens)``: the dirty spellings met in each text column, columns without any left out.

    One pass; every buffer holds at most ``len(dirty)`` strings. A null counts as ``nan``.
    """
    columns = _text_columns(df)
    found = df.agg(*[
        F.array_sort(F.collect_set(F.when(text.isin(*dirty), text))).alias(c)
        for c in columns
        for text in [F.lower(strip(F.coalesce(F.col(c), F.lit("nan"))))]
    ])
    return found.unpivot([], columns, "column", "tokens").filter(F.size("tokens") > 0)


def profile(df: DataFrame) -> DataFrame:
    """Rows ``(column, rows, non_null)``."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.unpivot(["__rows"], df.columns, "column", "non_null").withColumnRenamed("__rows", "rows")
