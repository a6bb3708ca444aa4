"""The most frequent values of a stream of words without counting all of them.

First every task keeps a summary of at most ``capacity`` words. When more come, all counts are lowered by as much as leaves
half of them, and the lowered amount is added to the task's error: a word's count in the task lies between its kept count and that plus
the error. Merged, the summaries bound each word's number of occurrences from both sides. Words whose upper bound reaches the
``n``-th largest lower bound are candidates, and only these are counted exactly in a second pass. What is shuffled are summaries and
candidates, never the vocabulary. If the bounds leave words that no summary holds, the first pass is repeated with more capacity.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import materialise, small_side

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 20_000
GROWTH = 8


class Summary:
    """Counts of the most frequent values, each too small by at most ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.error = capacity, Counter(), 0

    def add(self, counts: dict[str, int]) -> None:
        self.counts.update(counts)
        if len(self.counts) > self.capacity:
            cut = sorted(self.counts.values(), reverse=True)[self.capacity // 2]
            self.counts = Counter({v: c - cut for v, c in self.counts.items() if c > cut})
            self.error += cut


def summaries(df: DataFrame, words: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows ``(word, n)`` of every task's summary of an array column, and one row per task with a null word and its error."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            counted = pc.value_counts(batch[0].flatten())
            summary.add(dict(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True)))
        names, counts = [*summary.counts, None], [*summary.counts.values(), summary.error]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    return df.select(F.filter(words, F.isnotnull).alias("w")).where("w IS NOT NULL").mapInArrow(summarise, "word string, n long")


def heavy_candidates(df: DataFrame, words: str, n: int, capacity: int = CAPACITY) -> DataFrame | None:
    """Words ``(word, low, high)`` that can be among the ``n`` most frequent, with bounds of their numbers; None if capacity is short."""
    kept = materialise(summaries(df, words, capacity))
    error = kept.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    merged = kept.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("low"))
    least = merged.orderBy(F.desc("low")).limit(n).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
    if error and (least["n"] < n or least["low"] <= error):
        return None  # a word that no summary kept could be one of them
    floor = least["low"] if least["n"] >= n else 0
    return merged.where(F.col("low") + error >= floor).withColumn("high", F.col("low") + error)


def heavy_words(df: DataFrame, words: str, n: int, capacity: int = CAPACITY) -> DataFrame:
    """The ``n`` most frequent words of an array column with their exact numbers ``(word, n)``; ties go to the smaller word."""
    candidates = None
    while candidates is None:
        candidates, capacity = heavy_candidates(df, words, n, capacity), capacity * GROWTH
    listed = small_side(materialise(candidates.select("word")))
    counted = df.select(F.explode(words).alias("word")).join(listed, "word").groupBy("word").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(n)


def singular_form(word: Column) -> Column:
    """The word without a single final ``s``, as word counts merge plurals."""
    plural = word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 1)
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def heavy_frequencies(df: DataFrame, words: str, n: int, capacity: int = CAPACITY) -> DataFrame:
    """As :func:`reviewlens.operators.text.word_frequencies` with plurals merged: ``(word, n, weight)``."""
    forms = df.select(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("word"), singular_form(w).alias("form"))).alias("w"))
    top = materialise(heavy_words(forms.select(F.col("w.form").alias("form")), "form", n, capacity).withColumnRenamed("word", "form"))
    used = forms.select(F.inline("w")).join(small_side(top.select("form")), "form").groupBy("form").agg(
        F.bool_or(F.col("word") == F.col("form")).alias("own"), F.max("word").alias("word"))
    named = top.join(used, "form").select(F.when(F.col("own"), F.col("form")).otherwise(F.col("word")).alias("word"), "n")
    return named.withColumn("weight", F.col("n") / top.agg(F.max("n")).scalar())
