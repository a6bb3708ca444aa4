"""Shared pieces of the registered queries: table access and the review view in both languages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.sources.tables import spread


@dataclass(frozen=True)
class Entry:
    """A query and, if it can be written, SQL with the same result."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    """Entries by name, filled by decorating the query functions."""

    def add(self, sql: str | None = None):
        def register(run):
            self[run.__name__] = Entry(run, sql)
            return run

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """Columns of the documents, spread over the cores if their file is a single split."""
    return spread(table(spark, folder, "documents").select(*columns))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round result columns so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# A review is an order line: the customer's nation is the user, the part is the entity.
def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The review view."""
    wanted = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    lines, orders = spread(table(spark, folder, "lineitem").select(*wanted)), table(spark, folder, "orders")
    customers, nations, parts = (table(spark, folder, t) for t in ("customer", "nation", "part"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("l_partkey").alias("item"), F.col("p_name").alias("name"), F.col("n_name").alias("user"),
            F.col("c_mktsegment").alias("segment"), F.col("o_orderdate").cast("date").alias("day"),
            F.col("l_linenumber").alias("nights"), F.month("o_orderdate").alias("month"), F.col("p_type").alias("room"),
            F.col("l_quantity").alias("score"), F.col("l_orderkey").alias("ordr"),
        )
    )


REVIEWS_SQL = """reviews AS (
  SELECT l_partkey AS item, p_name AS name, n_name AS user, c_mktsegment AS segment,
         CAST(o_orderdate AS DATE) AS day, l_linenumber AS nights, CAST(month(o_orderdate) AS INTEGER) AS month,
         p_type AS room, l_quantity AS score, l_orderkey AS ordr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def quoted(words) -> str:
    """Words as a SQL list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
