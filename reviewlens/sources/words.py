"""Word lists and replacement dictionaries kept as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.cleaning import strip
from reviewlens.plans.positions import with_position


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``key, value`` lines as ``(ord, key, value)``; lines without a tab are skipped.

    A repeated key keeps its first place and takes its last value. ``path`` is a file or a folder of files; lines are
    ordered by file name and by their place in the file, as read block by block.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    # Tabs at the ends belong to the line break, not to the pair.
    pairs = lines.filter(F.col("value").contains("\t")).select(
        "file", "block", "line", F.split(strip(F.col("value")), "\t").alias("pair")
    )
    placed = with_position(pairs, [F.col(c).asc() for c in ("file", "block", "line")], "ord")
    keyed = placed.select("ord", F.col("pair")[0].alias("key"), F.try_element_at("pair", F.lit(2)).alias("value"))
    return keyed.groupBy("key").agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value")).select("ord", "key", "value")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line: trimmed, blank lines skipped, each word once."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).filter(F.col("word") != "").distinct()
