"""From raw documents to token ids: quality, line dedup, near dedup, decontamination, encoding.

Every stage takes (spark, docs, folder of tables) and works on all rows that the one before kept. All but the last
return the columns of ``docs``. Empty inputs give empty outputs; rows with null ids or repeated ids pass the
stages as documents of their own, but copies of one text stay only once. A stage bounds the session's Arrow batches
(``BATCH_BYTES``), which stays so after it, as its result is lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.catalog.base import Entry, table
from reviewlens.llm import decontaminate, jaccard, lines, quality
from reviewlens.llm.queries import LEAST_QUALITY, encoded
from reviewlens.plans.sizing import materialise, small_side

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Bytes of text that a Python worker is handed at a time; Spark's own bound is sixteen times that.
BATCH_BYTES = 4 * 1024 * 1024


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches are small: workers serve all stages and keep the memory of the largest batch."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, folder)

    return run


@in_small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not reject; without labels of both kinds it rejects none."""
    model = quality.train(docs, table(spark, folder, "labels"))
    if not model.weights.any():
        return docs
    return quality.score(docs, model, name="__score").where(F.col("__score") >= LEAST_QUALITY).select(docs.columns)


@in_small_batches
def drop_common_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that ten documents or more share; the number of characters follows."""
    cut = lines.drop_frequent_lines(docs, least_docs=10).select(docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the smallest id.

    Rows of one id count as one document if their texts are equal; an id goes only if all its rows do. Documents without
    an id can't be told apart and stay.
    """
    near = materialise(jaccard.near_copies(docs, k=5, percent=80))
    ids = near.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    ids = materialise(ids)
    kept = docs.join(small_side(ids.where("NOT first").select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    return kept if ids.where("first AND rows > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


@in_small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    items = table(spark, folder, "benchmark")
    found = decontaminate.benchmark_matches(docs, items, name="__matches")
    return found.where(F.size("__matches") == 0).select(docs.columns)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids with the digest of the text they decode to."""
    return encoded(docs, *[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("quality_classifier", keep_quality), ("line_dedup", drop_common_lines), ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark), ("byte_bpe", encode),
]

#: A learned stage and a search by edit distance have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ENTRY = Entry(run, ORACLE_SQL)
