"""Exact quantiles of unbounded columns in two passes.

``percentile`` keeps every distinct value of a column in one aggregation buffer. Here the first pass
takes a mergeable sketch, which brackets each wanted rank, together with the plain summaries. The
second counts the values inside the brackets one by one and those between brackets in one number; a
running total over these counts gives the ranks, a distributed one if there are more of them than one task should sort. Where
a bracket misses its rank the second pass repeats with wider brackets, at last with the whole range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.plans.positions import with_running_total
from reviewlens.plans.sizing import fits_broadcast, materialise

# Half widths of the brackets, as shares of the rows.
MARGINS = (1e-4, 1e-2, 1.0)
ACCURACY = 100_000
# Counts that a single task sorts per column.
SORTED_ROWS = 1_000_000


@dataclass
class Summary:
    """One column: plain summaries, and its quantiles by probability."""

    column: str
    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    quantiles: dict[float, float] = field(default_factory=dict)


def summarise(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> list[Summary]:
    """Summaries of all columns; nulls are ignored, quantiles linearly interpolated."""
    values = df.select(*[F.col(c).cast("double").alias(f"v_{i}") for i, c in enumerate(columns)])
    ends = [min(max(p + side * m, 0.0), 1.0) for p in probs for m in MARGINS for side in (-1, 1)]
    row = values.agg(*[
        F.struct(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"),
            F.percentile_approx(v, ends, ACCURACY).alias("ends"),
        ).alias(v)
        for v in values.columns
    ]).first()
    found = [Summary(c, *row[f"v_{i}"][:5]) for i, c in enumerate(columns)]

    def bracket(i: int, j: int, level: int) -> tuple[float, float]:
        if level == len(MARGINS) - 1:
            return found[i].low, found[i].high
        at = 2 * (j * len(MARGINS) + level)
        return tuple(row[f"v_{i}"]["ends"][at : at + 2])

    # Interpolated ranks lie up to two rows beside the sketch's.
    start = [next((k for k, m in enumerate(MARGINS) if m * s.count >= 2), len(MARGINS) - 1) for s in found]
    open_ = {(i, j): start[i] for i, s in enumerate(found) if s.count for j in range(len(probs))}
    while open_:
        picked = _pick(values, {cell: bracket(*cell, level) for cell, level in open_.items()}, {
            (i, j): (found[i].count - 1) * probs[j] for i, j in open_
        })
        for (i, j), level in list(open_.items()):
            low, high = picked[i, j]
            if low is None or high is None:
                open_[i, j] = level + 1
                continue
            rank = (found[i].count - 1) * probs[j]
            found[i].quantiles[probs[j]] = low + (high - low) * (rank - floor(rank)) if high != low else low
            del open_[i, j]
    return found


def _pick(
    values: DataFrame, brackets: dict[tuple[int, int], tuple[float, float]], ranks: dict[tuple[int, int], float]
) -> dict[tuple[int, int], tuple[float | None, float | None]]:
    """The values at the ranks around each wanted one, None where no bracket holds them."""
    parts = []
    for i in sorted({i for i, _ in brackets}):
        merged: list[list[float]] = []
        for low, high in sorted(b for (c, _), b in brackets.items() if c == i):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        v = F.col(f"v_{i}")
        # Even zones lie between the brackets, odd ones are brackets.
        zone = sum(((v >= low).cast("int") + (v > high).cast("int") for low, high in merged), F.lit(0))
        parts.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("c"), zone.alias("zone"), F.when(zone % 2 == 1, v).alias("value"))))
    counted = values.select(F.inline(F.array_compact(F.array(*parts)))).groupBy("c", "zone", "value").agg(F.count("*").alias("n"))
    counted = materialise(counted)
    if fits_broadcast(counted, SORTED_ROWS):
        placed = counted.withColumn("upto", F.sum("n").over(W.partitionBy("c").orderBy("zone", "value")))
    else:
        placed = with_running_total(counted, [F.col("zone").asc(), F.col("value").asc()], "upto", ["c"], F.col("n"))
    # One row per column and wanted rank.
    wanted = values.sparkSession.createDataFrame([(i, j, floor(r), ceil(r)) for (i, j), r in ranks.items()], "c int, j int, below long, above long")

    def at(position: str):
        return F.min(F.when(F.col("upto") > F.col(position), F.struct("upto", "value")))["value"]

    chosen = placed.join(F.broadcast(wanted), "c").groupBy("c", "j").agg(at("below").alias("low"), at("above").alias("high"))
    return {(r["c"], r["j"]): (r["low"], r["high"]) for r in chosen.collect()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows ``(column, prob, value)``, linearly interpolated, nulls ignored; none for a column without values."""
    rows = [(s.column, p, v) for s in summarise(df, columns, list(probs)) for p, v in s.quantiles.items()]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
