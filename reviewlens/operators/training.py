"""Training a factor model of few users and any number of items without moving the items' factors.

MLlib sends every item's factor to each block of users that rated it, in each iteration: with ten blocks, ten copies of all items'
factors. With few users it is cheaper to leave the ratings where they lie, by item. The users' factors go to all tasks. A task solves its
items' factors by ``(sum u u' + reg * n * I) v = sum rating * u`` and adds them to the like sums of every user. Only those sums are
shuffled: one row per task and user, whatever the number of items. Starting factors and model are MLlib's, and so are the equations, solved
in double precision and stored as floats.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import materialise
from reviewlens.session import shared_folder

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers in all users' sums, which every task holds; beyond them MLlib trains. Numbers that a task holds of its items at a time.
SUMS = 2**17
CELLS = 2**20


def users_of(ratings: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """One rating ``(user, item, rating, n)`` per user and the number of the user's ratings; a null or NaN shows if there is one."""
    shown = [F.when(F.count(c) == F.count("*"), F.max(c)).alias(c) for c in (item, rating)]
    return materialise(ratings.groupBy(user).agg(*shown, F.count("*").alias("n")))


def _solved(
    batch: pa.RecordBatch, ids: np.ndarray, factors: np.ndarray, regularisation: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Items with their numbers and sums of ratings by user, and their factors; some items at a time."""
    many, rank = factors.shape
    squares = (factors[:, :, None] * factors[:, None, :]).reshape(many, -1)
    row = pc.list_parent_indices(batch["cells"]).to_numpy()
    user, n, total = (c.to_numpy() for c in batch["cells"].flatten().flatten())
    at, item = np.searchsorted(ids, user), batch["item"].to_numpy()
    step = max(1, CELLS // max(many, rank * rank))
    for a in range(0, len(item), step):
        size = min(step, len(item) - a)
        lo, hi = np.searchsorted(row, [a, a + size])
        place = (row[lo:hi] - a) * many + at[lo:hi]
        counts, sums = (np.bincount(place, w[lo:hi], size * many).reshape(size, many) for w in (n, total))
        gram = (counts @ squares).reshape(size, rank, rank) + regularisation * counts.sum(1)[:, None, None] * np.eye(rank)
        found = np.linalg.solve(gram, (sums @ factors)[:, :, None])[:, :, 0]
        yield item[a : a + size], counts, sums, found.astype(np.float32)


def fit_few_users(als: ALS, ratings: DataFrame, users: DataFrame, iterations: int, regularisation: float) -> ALSModel:
    """The model that ``als`` would train in so many iterations on integer ids; ``users`` are :func:`users_of` these ratings."""
    user, item, rating = als.getUserCol(), als.getItemCol(), als.getRatingCol()
    # No iteration: the starting factors, which depend on the users' ids, the seed and the number of blocks only.
    begun = als.copy({als.maxIter: 0}).fit(users.drop("n"))
    rank = begun.rank
    known = users.select(F.col(user).alias("id"), "n").join(begun.userFactors, "id").orderBy("id").collect()  # few users
    ids, number = np.array([r["id"] for r in known]), np.array([r["n"] for r in known])
    start = np.array([r["features"] for r in known], np.float32).astype(np.float64)

    # Repeated ratings of a pair fold before they move, so that an item has one cell per user at most.
    pairs = ratings.groupBy(F.col(item).alias("item"), F.col(user).alias("user")).agg(F.count("*").alias("n"), F.sum(F.col(rating).cast("double")).alias("total"))
    held = materialise(pairs.groupBy("item").agg(F.collect_list(F.struct("user", "n", "total")).alias("cells")))

    def step(factors: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram, right = np.zeros((len(ids), rank * rank)), np.zeros((len(ids), rank))
            for batch in batches:
                for _, counts, totals, found in _solved(batch, ids, factors, regularisation):
                    v = found.astype(np.float64)
                    gram += counts.T @ (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)
                    right += totals.T @ v
            whole = np.concatenate([gram, right], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(list(whole), pa.list_(pa.float64()))], ["at", "sums"])

        def solve(group: pa.Table) -> pa.Table:
            at = group["at"][0].as_py()
            whole = np.sum([x.values.to_numpy() for x in group["sums"]], 0)
            gram = whole[: rank * rank].reshape(rank, rank) + regularisation * number[at] * np.eye(rank)
            found = np.linalg.solve(gram, whole[rank * rank :]).astype(np.float32)
            return pa.table([pa.array([at]), pa.array([found], pa.list_(pa.float32()))], ["at", "features"])

        made = held.mapInArrow(sums, "at long, sums array<double>").groupBy("at").applyInArrow(solve, "at long, features array<float>")
        return np.array([r["features"] for r in sorted(made.collect())], np.float64)  # few users

    last = now = start
    for _ in range(iterations):
        last, now = now, step(now)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, _, _, found in _solved(batch, ids, last, regularisation):
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(list(found), pa.list_(pa.float32()))], ["id", "features"])

    # A stored model is its settings and two tables of factors.
    path = shared_folder(ratings.sparkSession)
    begun.write().save(path)
    made = begun.userFactors.sparkSession.createDataFrame(list(zip(ids.tolist(), now.tolist(), strict=True)), "id int, features array<float>")
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/userFactors")
    held.mapInArrow(items, "id int, features array<float>").write.mode("overwrite").parquet(f"{path}/itemFactors")
    return ALSModel.load(path)
