"""Statistics that are kept up to date: a table of mergeable summaries per group and day.

A row holds the number of values, their mean, the sum of squared deviations, minimum, maximum, a KLL sketch for quantiles and an HLL
sketch for the number of different things. New rows are summarised on their own and appended, so an update reads only
what is new; a reading merges the rows it needs, of any groups and days. Quantiles are within :func:`rank_error` of the wanted share of
the values (with 99 % confidence), numbers of different things within some per cent; the rest is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.plans.sizing import materialise

# Size of the sketches: 2**12 HLL registers, about 5 kB for a KLL sketch of doubles.
KLL, HLL = 400, 12


def rank_error(k: int = KLL) -> float:
    """How far the share of values below a quantile may lie from the one asked for."""
    return 2.296 / k**0.9723


def summarise(df: DataFrame, group: Sequence[str], value: str, things: str) -> DataFrame:
    """One summary per group: of a number column, and of the different values of another column."""
    v = F.col(value).cast("double")
    return df.groupBy(*group).agg(
        F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, F.lit(KLL)).alias("kll"), F.hll_sketch_agg(things, HLL).alias("hll"),
    )


def merge(summaries: DataFrame, group: Sequence[str]) -> DataFrame:
    """Summaries of fewer groups; a summary per group and day merges to one per group, for instance."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    squares = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return summaries.groupBy(*group).agg(
        F.sum("rows").alias("rows"), total.alias("n"), mean.alias("mean"), F.greatest(squares - total * mean * mean, F.lit(0.0)).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("kll", F.lit(KLL)).alias("kll"), F.hll_union_agg("hll").alias("hll"),
    )


def append(new: DataFrame, path: str, group: Sequence[str], day: str, value: str, things: str) -> None:
    """Add the summaries of new rows to the stored table; reads the new rows only."""
    summarise(new, [*group, day], value, things).write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, group: Sequence[str], day: str, into: str) -> None:
    """Write the table with one row per group and day to another place."""
    merge(spark.read.parquet(path), [*group, day]).write.mode("overwrite").parquet(into)


def report(summaries: DataFrame, group: Sequence[str], probs: dict[str, float], name: str = "distinct") -> DataFrame:
    """Number, mean, sample deviation, minimum, quantiles, maximum and number of different things per group."""
    merged = materialise(merge(summaries, group))
    quantiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(p))).alias(c) for c, p in probs.items()]
    return merged.select(
        *group, F.col("n").alias("count"), "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
        F.col("low").alias("min"), *quantiles, F.col("high").alias("max"), F.hll_sketch_estimate("hll").alias(name),
    )
