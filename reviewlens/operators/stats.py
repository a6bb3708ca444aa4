"""Descriptive statistics: summaries, frequencies, trends, histograms, means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.functions.cleaning import half_even, month_of
from reviewlens.plans.quantiles import summarise
from reviewlens.plans.sizing import BROADCAST_ROWS, join_lookup

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    rows = [
        (s.column, s.count, s.mean, s.std, s.low, *[s.quantiles.get(p) for p in QUARTILES.values()], s.high)
        for s in summarise(df, columns, list(QUARTILES.values()))
    ]
    numbers = ["mean", "std", "min", *QUARTILES, "max"]
    joined = df.sparkSession.createDataFrame(rows, "column string, count long, " + ", ".join(f"{c} double" for c in numbers))
    if digits is not None:
        joined = joined.withColumns({c: half_even(F.col(c), digits) for c in numbers})
    return joined.select("column", "count", *numbers)


def distinct_per_group(
    df: DataFrame, group: str, value: str, n: int | None = None, approximate: bool = False, name: str = "n"
) -> DataFrame:
    """Number of different values per group, most first, the first ``n`` groups if given."""
    counter = F.approx_count_distinct(value) if approximate else F.countDistinct(value)
    counted = df.filter(F.col(group).isNotNull()).groupBy(group).agg(counter.alias(name))
    return counted.orderBy(F.desc(name), group).limit(n) if n is not None else counted


def mean_per_entity(df: DataFrame, entity: str, value: str, name: str = "mean") -> DataFrame:
    """Mean per entity."""
    return df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.avg(value).alias(name))


def frequencies(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, nulls left out, in no particular order."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))


def top_categories(df: DataFrame, column: str, n: int | None = None, name: str = "n") -> DataFrame:
    """Values by descending count, ties by value; the first ``n`` if given."""
    ordered = frequencies(df, column, name).orderBy(F.desc(name), column)
    return ordered.limit(n) if n is not None else ordered


def frequencies_in_key_order(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, sorted by value."""
    return frequencies(df, column, name).orderBy(column)


def category_share(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values and their share of those ``n`` together."""
    top = top_categories(df, column, n)
    # The window spans the n rows left by the limit, never the table.
    return top.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def averages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the mean of each column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def monthly_trend(df: DataFrame, date: str, name: str = "n") -> DataFrame:
    """Rows per calendar month, undated rows left out, empty months not invented."""
    months = df.select(month_of(F.col(date)).alias("month")).filter(F.col("month").isNotNull())
    return months.groupBy("month").agg(F.count("*").alias(name))


def _bins(df: DataFrame, bins: int) -> DataFrame:
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over minimum..maximum, empty bins included, the last one closed.

    A constant column gets the range value ± 0.5.
    """
    value = F.col(column).cast("double")
    flat = F.min(value) == F.max(value)
    low, high = F.when(flat, F.min(value) - 0.5).otherwise(F.min(value)), F.when(flat, F.max(value) + 0.5).otherwise(F.max(value))
    bounds = df.agg(F.struct(low.alias("low"), ((high - low) / bins).alias("width")).alias("b")).scalar()
    placed = df.filter(value.isNotNull()).select(value.alias("value"), bounds.alias("b"))
    step = F.floor((F.col("value") - F.col("b.low")) / F.col("b.width"))
    counted = placed.select(F.least(step, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    # At most `bins` counted rows.
    filled = _bins(df, bins).join(F.broadcast(counted), "bin", "left").withColumn("b", bounds)
    return filled.select(
        "bin",
        (F.col("b.low") + F.col("bin") * F.col("b.width")).alias("low"),
        (F.col("b.low") + (F.col("bin") + 1) * F.col("b.width")).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def histogram_integer_edges(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Unit bins with edges ``low..high``; the last bin is closed, values outside are dropped."""
    value = F.col(column).cast("double")
    last = high - low - 1
    inside = df.filter(value.between(low, high))
    place = F.least(F.floor(value) - low, F.lit(last)).cast("int").alias("bin")
    counted = inside.select(place).groupBy("bin").agg(F.count("*").alias("n"))
    filled = _bins(df, last + 1).join(F.broadcast(counted), "bin", "left")
    return filled.select(
        (F.col("bin") + low).alias("low"), (F.col("bin") + low + 1).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def report_totals(df: DataFrame, name_col: str, score: str) -> DataFrame:
    """One row: number of rows, of different names, and the mean score."""
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(name_col).alias("names"), F.avg(score).alias("mean_score")
    )


def flag_count(df: DataFrame, flag) -> DataFrame:
    """One row: how many rows have the flag set."""
    return df.agg(F.count_if(flag).alias("flagged"))


def row_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows."""
    return df.agg(F.count("*").alias("rows"))


def distinct_sorted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct value combinations in order."""
    return df.select(*columns).distinct().orderBy(*columns)


def mean_on_rows(
    df: DataFrame, key: str, value: str, name: str, max_rows: int = BROADCAST_ROWS, of: DataFrame | None = None
) -> DataFrame:
    """Repeat the mean of each key on all its rows; rows without a key get null.

    Aggregated first and joined back: a window would put all rows of a hot key into one task. The means are those of the rows
    ``of``, by default the same.
    """
    means = (df if of is None else of).filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    return join_lookup(df, means, [key], "left", max_rows, derived=True)


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: root mean squared error."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), 2))).alias("rmse"))
