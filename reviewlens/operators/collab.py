"""Collaborative filtering: dense ids, splits, ALS training, scoring and serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.operators.training import SUMS, fit_few_users, users_of
from reviewlens.plans.positions import with_position
from reviewlens.plans.sizing import join_lookup

# The training settings to be matched.
RANK, ITERATIONS, REGULARISATION, SEED = 20, 10, 0.1, 42


def dense_index(df: DataFrame, column: str, index: str) -> DataFrame:
    """Ids ``(column, index)`` 0, 1, 2, … by descending frequency, ties by value; nulls have none.

    Labels stay in a table: an indexer model would pull all of them through the driver.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    placed = with_position(counts, [F.col("__n").desc(), F.col(column).asc()], index)
    return placed.select(column, F.col(index).cast("int").alias(index))


def with_index(df: DataFrame, column: str, index: str) -> DataFrame:
    """Add the dense id of a column; rows without a value are skipped."""
    return join_lookup(df, dense_index(df, column, index), [column], "inner")


def random_split(df: DataFrame, train: float = 0.8, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Spark's random split: depends on how the input is partitioned."""
    parts = df.randomSplit([train, 1 - train], seed=seed)
    return parts[0], parts[1]


def split_mark(key: Sequence[str], train_percent: int = 80, seed: int = SEED):
    """True for rows whose key hashes into the training share."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return bucket < train_percent


def hash_split(
    df: DataFrame, key: Sequence[str], train_percent: int = 80, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same rows on every run, whatever the partitioning."""
    mark = split_mark(key, train_percent, seed)
    return df.filter(mark), df.filter(~mark)


def clean_ratings(df: DataFrame, user: str, item: str, rating: str, aggregate: str | None = None) -> DataFrame:
    """Rows with all three parts present and a real number; ``aggregate="avg"`` folds repeated pairs."""
    kept = df.filter(
        F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(rating).isNotNull() & ~F.isnan(F.col(rating).cast("double"))
    )
    if aggregate is None:
        return kept
    if aggregate != "avg":
        raise ValueError("aggregate is None or 'avg'")
    return kept.groupBy(user, item).agg(F.avg(rating).alias(rating))


def fit_als(
    ratings: DataFrame, user: str, item: str, rating: str, *, rank: int = RANK, iterations: int = ITERATIONS,
    regularisation: float = REGULARISATION, seed: int = SEED, blocks: int | None = None,
) -> ALSModel:
    """Explicit-feedback ALS on integer ids; users or items unseen in training get no prediction.

    ``blocks`` sets the number of user and item blocks, on which the starting factors depend. With few users the iterations move
    sums per user instead of the items' factors (:mod:`reviewlens.operators.training`); with more, MLlib's blocks exchange factors.
    """
    als = ALS(
        userCol=user, itemCol=item, ratingCol=rating, implicitPrefs=False, coldStartStrategy="drop",
        rank=rank, maxIter=iterations, regParam=regularisation, seed=seed,
    )
    if blocks:
        als = als.setNumBlocks(blocks)
    rows = ratings.select(user, item, F.col(rating).cast("float").alias(rating))
    if iterations and all(rows.schema[c].dataType == T.IntegerType() for c in (user, item)):
        users = users_of(rows, user, item, rating)
        if users.count() * rank * (rank + 1) <= SUMS:
            return fit_few_users(als, rows, users, iterations, regularisation)
    return als.fit(rows)


def predict(model: ALSModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` to held-out rows."""
    return model.transform(rows)


def evaluate_rmse(predictions: DataFrame, label: str, prediction: str = "prediction") -> float:
    """Root mean squared error of scored rows."""
    return RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol=prediction).evaluate(predictions)


def recommend_for_user(
    model: ALSModel, items: DataFrame, user_id: int, k: int = 10, attributes: Sequence[str] = ()
) -> DataFrame:
    """Best ``k`` items for one user, with item attributes.

    ``items`` holds the model's item column and the attributes; repeated rows are dropped.
    """
    item = model.getItemCol()
    candidates = items.select(item, *attributes).distinct().withColumn(model.getUserCol(), F.lit(user_id))
    scored = model.transform(candidates).filter(F.col("prediction").isNotNull())
    return scored.orderBy(F.desc("prediction"), item).limit(k).select(item, *attributes, "prediction")


def recommend_for_users(
    model: ALSModel, k: int = 10, users: DataFrame | None = None, items: DataFrame | None = None
) -> DataFrame:
    """Best ``k`` items for the given users, or for all: ``(user, item, prediction, rank)``."""
    user, item = model.getUserCol(), model.getItemCol()
    found = model.recommendForAllUsers(k) if users is None else model.recommendForUserSubset(users.select(user), k)
    flat = found.select(user, F.posexplode("recommendations").alias("pos", "r")).select(
        user, F.col(f"r.{item}").alias(item), F.col("r.rating").alias("prediction"), (F.col("pos") + 1).alias("rank")
    )
    return flat if items is None else join_lookup(flat, items, [item], "left")


def save_model(model: ALSModel, path: str) -> None:
    """Write the factors, replacing what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> ALSModel:
    """Read saved factors."""
    return ALSModel.load(path)
