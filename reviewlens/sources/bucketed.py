"""Tables that lie in buckets of a key, so that joins and sums by this key move no rows.

Written once with the same key and number of buckets, two tables are joined bucket by bucket: the shuffle is paid when they are
written and not again by every join. A bucket is one file, sorted by the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import shared_folder


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Store a table in buckets of ``key`` and return its name in the session's catalogue.

    Without a ``path`` it lies in the shared folder of intermediates. Rows with a null key are one bucket's.
    """
    table = name or f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, key).sortWithinPartitions(key)
    writer = placed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path or shared_folder(df.sparkSession))
    writer.mode("overwrite").saveAsTable(table)
    return table


def enrich_bucketed(spark: SparkSession, rows: str, entities: str, key: str, columns: Sequence[str]) -> DataFrame:
    """As :func:`reviewlens.operators.joins.enrich`, from two tables in equal buckets of ``key``."""
    return spark.table(rows).join(spark.table(entities).select(key, *columns).hint("merge"), key, "left")


def drop_orphans_bucketed(spark: SparkSession, rows: str, entities: str, key: str, name_col: str) -> DataFrame:
    """As :func:`reviewlens.operators.joins.drop_orphans`, from two tables in equal buckets of ``key``."""
    named = spark.table(entities).where(F.col(name_col).isNotNull()).select(key)
    return spark.table(rows).join(named.hint("merge"), key, "left_semi")


def mean_on_rows_bucketed(spark: SparkSession, rows: str, key: str, value: str, name: str) -> DataFrame:
    """As :func:`reviewlens.operators.stats.mean_on_rows`, from a table in buckets of ``key``."""
    means = spark.table(rows).where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    return spark.table(rows).join(means.hint("merge"), key, "left")
