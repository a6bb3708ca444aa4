"""Review and entity tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.cleaning import lenient_date


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text, so that dirty numbers survive reading."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, multiline: bool
) -> DataFrame:
    """CSV with a header. Without a schema every column is text; no inference pass is made.

    ``multiline`` says whether texts may hold line breaks inside quotes. Such a file is one task,
    whatever its size: deliver many files, or store the table as Parquet after the first read.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        .option("inferSchema", False).option("encoding", "UTF-8")
    )
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a freshly read table whose files make fewer splits than there are cores.

    For small tables with costly row expressions; a table of many splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_clean(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
    date_columns: Sequence[str] = (), multiline: bool = True,
) -> DataFrame:
    """A cleaned table (``multiline`` is for CSV); dates kept as text are read again, null where they do not parse."""
    df = spark.read.parquet(path) if fmt == "parquet" else read_raw_csv(spark, path, schema, multiline=multiline)
    return df.withColumns({c: lenient_date(F.col(c)) for c in date_columns}) if date_columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table, optionally partitioned."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV table with header; quotes are doubled, line breaks stay inside quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table from driver values, with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)
