"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.session import shared_folder

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate that several steps read, and go on from the written table.

    Parquet in the session's shared checkpoint folder: survives the loss of an executor, cuts the
    lineage, and later steps read only the columns they need.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``, reading at most ``max_rows + 1`` of its rows into the count."""
    nested = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, nested)]
    # Vectors of MLlib: a number takes 8 bytes and is written with 4 characters or more.
    vectors = [f.name for f in df.schema.fields if isinstance(f.dataType, T.UserDefinedType)]
    fixed = 8 * (len(df.columns) - len(wide) - len(vectors))
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in wide]
    text += [2 * F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in vectors]
    width = sum(text, F.lit(fixed).cast("long"))
    probe = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("size")).first()
    return probe["n"] <= max_rows and (probe["size"] or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it measures small; otherwise leave the choice to the planner.

    Beyond the bound the join is a shuffle join whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def join_lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    derived: bool = False,
) -> DataFrame:
    """Join a large table with a per-key table, by name, broadcasting the latter only when it measures small.

    ``derived`` says that the per-key table is costly to compute: it is then written once, instead of
    being computed for the measurement and again for the join.
    """
    return rows.join(small_side(materialise(table) if derived else table, max_rows), list(on), how)


def join_lookup_null_safe(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    derived: bool = False,
) -> DataFrame:
    """As :func:`join_lookup`, with null keys equal to each other."""
    source = materialise(table) if derived else table
    renamed = source.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in source.columns])
    condition = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in on]
    joined = rows.join(small_side(renamed, max_rows), condition, how)
    return joined.drop(*[f"__{c}" for c in on])
