"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import materialise


ONE_TASK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these links beside the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        small = np.minimum(label[left], label[right])
        now = label.copy()
        np.minimum.at(now, label[left], small)
        np.minimum.at(now, label[right], small)
        now = now[now]
        while not np.array_equal(now, now[now]):
            now = now[now]
        label = now
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by stars; their number is at most that of the task's nodes."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.append(a, batch["a"].to_numpy()), np.append(b, batch["b"].to_numpy())
        nodes, roots = forest(a, b)
        a, b = nodes[nodes != roots], roots[nodes != roots]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) for every node of the links ``a, b`` (long, not null).

    Rounds of large-star and small-star: a node hooks its larger neighbours, then its smaller ones, to its
    smallest neighbour, until nothing changes. A hub's neighbours are only ever aggregated (partial minimum
    before the shuffle) and joined back, never gathered. Each round is written to the shared folder. No
    links: no rows.
    """
    links = materialise(links.where("a <> b").mapInArrow(_contract, "a long, b long"))
    if links.count() <= ONE_TASK:  # measured, 16 bytes a row: one more contraction ends it
        links = links.coalesce(1).mapInArrow(_contract, "a long, b long")
        return materialise(_named(links))
    marked = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = materialise(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        state = _state(links)
        if state == marked:
            break
        marked = state
    return materialise(_named(links))


def _named(stars: DataFrame) -> DataFrame:
    """Every node of the stars with its centre; a centre's is itself."""
    centres = stars.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(centres)
