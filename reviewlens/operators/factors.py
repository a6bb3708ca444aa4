"""Serving a factor model: exact best items per user without all products, and factors for users that training has not seen.

**Best items.** A score is the inner product of two factors, at most the product of their lengths (Cauchy-Schwarz). Items lie in
buckets by descending length. Every user meets the first bucket, which bounds the user's ``k``-th score from below; the buckets
whose longest factor, times the user's length, stays under it hold nothing better, and neither do those behind them. Users of one chunk
go to the items as they lie; more users are dealt into chunks by how deep they have to go, and a chunk meets runs of buckets: users
travel once per run and items once per chunk.

**New users.** With the items' factors fixed, a user's factor solves the same regularised least squares as in training:
``(sum v v' + reg * n * I) u = sum rating * v`` over the user's ``n`` ratings. The sums are taken where a user's ratings lie; only users
with many ratings are summed in several tasks, so one user with a third of all ratings is no single task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.plans.positions import with_position
from reviewlens.plans.sizing import join_lookup, materialise

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Items of a bucket, users of a chunk, numbers in the buckets that a chunk meets at once, ratings of a user that one task sums.
BUCKET = 4096
CHUNK = 4096
NUMBERS = 2**20
RATINGS = 10_000
# Products that a task holds at a time.
CELLS = 4_000_000
SLACK = 1e-9


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _length(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _found(user: np.ndarray, x: np.ndarray, depth: np.ndarray, item: np.ndarray, y: np.ndarray, bucket: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """User, item and score of the best items here for every user, of the buckets below the user's depth; the items lie by bucket."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    order = np.argsort(-depth, kind="stable")
    step = max(1, CELLS // max(1, len(item)))
    for lo in range(0, len(order) if len(item) else 0, step):
        at = order[lo : lo + step]
        scores, met = np.full((len(at), len(item)), -np.inf), np.zeros((len(at), len(item)), bool)
        for a, b in zip(starts, ends, strict=True):
            # Deeper users come first.
            n = int((depth[at] > bucket[a]).sum())
            scores[:n, a:b] = x[at[:n]] @ y[a:b].T
            if b - a <= k:
                met[:n, a:b] = True
            else:
                # As good as the k-th of the bucket.
                met[:n, a:b] = scores[:n, a:b] >= np.partition(scores[:n, a:b], -k, 1)[:, -k, None]
        source, column = np.nonzero(met)
        value = scores[source, column]
        # Highest first, ties by id; what is not a number counts as highest, as in the last ranking.
        best = np.lexsort((item[column], -value, ~np.isnan(value), source))
        source, column = source[best], column[best]
        first = np.arange(len(source)) - np.searchsorted(source, source) < k
        source, column = source[first], column[first]
        yield pa.RecordBatch.from_arrays([pa.array(user[at[source]]), pa.array(item[column]), pa.array(scores[source, column])], schema=_FOUND)


def _by_bucket(items: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, factors and buckets of items, by bucket."""
    items = items.sort_by("bucket")
    v = items["v"]
    return items["item"].to_numpy(), _rows(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v), items["bucket"].to_numpy()


_FOUND = pa.schema([("user", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "user long, item long, score double"


def _prepared(users: DataFrame, items: DataFrame, k: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with their bucket, the users' best of the first bucket, and users with the buckets they still have to meet."""
    asked = materialise(users.select(F.col("id").cast("long").alias("user"), F.col("features").alias("v"), _length("features").alias("length")))
    known = items.select(F.col("id").cast("long").alias("item"), F.col("features").alias("v"), _length("features").alias("length"))
    placed = with_position(known, [F.col("length").desc(), F.col("item").asc()], "pos")
    placed = materialise(placed.withColumn("bucket", F.floor(F.col("pos") / bucket).cast("int")).drop("pos"))
    head = placed.where("bucket = 0").select("item", "v").toArrow()  # one bucket

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = head["item"].to_numpy()
        flat = _rows(head["v"].combine_chunks()) if len(ids) else None
        for batch in batches:
            if batch.num_rows and len(ids):
                yield from _found(batch["user"].to_numpy(), _rows(batch["v"]), np.ones(batch.num_rows, np.int64), ids, flat, np.zeros(len(ids), np.int64), k)

    best = materialise(asked.select("user", "v").mapInArrow(first, _FOUND_DDL))
    least = best.groupBy("user").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bound = F.col("length") * (1 + SLACK)
    # One number per bucket. Buckets in order of length: those that can hold something as good are the first ones.
    longest = placed.groupBy("bucket").agg(F.max("length").alias("longest")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "longest"))), lambda b: b["longest"]))
    deep = F.size(F.filter("longest", lambda x: (F.col("n") < k) | (x * bound + SLACK >= F.col("least"))))
    waiting = asked.join(least, "user").withColumn("longest", longest.scalar()).withColumn("depth", deep)
    return placed, best, materialise(waiting.where("depth > 1").select("user", "v", "depth"))


def best_items(users: DataFrame, items: DataFrame, k: int = 10, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """The ``k`` items with the largest inner products for every user: ``(user, item, score, rank)``; ties go to the lower item.

    Both tables have ``id`` and ``features`` of one length, as a factor model stores them. For one user pass a table of one row.
    """
    placed, best, waiting = _prepared(users, items, k, bucket)
    # Rows of a user that comes more than once meet each other below, in either form.
    rows = waiting.groupBy("user").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    asking, deepest = rows.agg(F.sum(F.col("n") * F.col("n")), F.max("depth")).first()
    if asking and asking <= chunk:
        few = waiting.join(waiting.select("user"), "user").toArrow()  # one chunk

        def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            user, x, depth = few["user"].to_numpy(), _rows(few["v"].combine_chunks()), few["depth"].to_numpy()
            for batch in batches:
                yield from _found(user, x, depth, *_by_bucket(batch), k)

        best = best.unionByName(placed.where((F.col("bucket") > 0) & (F.col("bucket") < deepest)).select("item", "v", "bucket").mapInArrow(pass_by, _FOUND_DDL))
    elif asking:
        width = waiting.agg(F.max(F.size("v"))).first()[0]
        run = max(1, NUMBERS // max(1, width * bucket))
        runs = lambda last: F.sequence(F.lit(0), F.floor(last / run).cast("int"))
        at = with_position(waiting.select("user", "depth"), [F.col("depth").asc(), F.col("user").asc()], "pos")
        dealt = materialise(waiting.join(at.select("user", F.floor(F.col("pos") / chunk).cast("int").alias("chunk")), "user"))
        depths = dealt.groupBy("chunk").agg(F.max("depth").alias("most"))
        meetings = depths.select("chunk", "most", F.explode(runs(F.col("most") - 1)).alias("run"))
        held = placed.where("bucket > 0").withColumn("run", F.floor(F.col("bucket") / run).cast("int"))
        left = join_lookup(held, meetings, ["run"], "inner", derived=True).where("bucket < most").select("chunk", "run", "bucket", "item", "v")
        right = dealt.withColumn("run", F.explode(runs(F.col("depth") - 1))).select("chunk", "run", "user", "v", "depth")

        def meet(items: pa.Table, users: pa.Table) -> pa.Table:
            if not (items.num_rows and users.num_rows):
                return _FOUND.empty_table()
            user, x, depth = users["user"].to_numpy(), _rows(users["v"].combine_chunks()), users["depth"].to_numpy()
            return pa.Table.from_batches(_found(user, x, depth, *_by_bucket(items), k), _FOUND)

        more = left.groupBy("chunk", "run").cogroup(right.groupBy("chunk", "run")).applyInArrow(meet, _FOUND_DDL)
        best = best.unionByName(more)
    rank = F.row_number().over(W.partitionBy("user").orderBy(F.desc("score"), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def products_done(users: DataFrame, items: DataFrame, k: int = 10, bucket: int = BUCKET) -> DataFrame:
    """One row: products that :func:`best_items` computes, and those of all users with all items."""
    placed, _, waiting = _prepared(users, items, k, bucket)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    met = waiting.select(F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("users"))
    first = users.select(F.lit(0).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("users"))
    done = met.unionByName(first).join(sizes, "bucket").agg(F.sum(F.col("users") * F.col("n")).alias("done"))
    return done.withColumn("all", users.agg(F.count("*")).scalar() * items.agg(F.count("*")).scalar())


def _solved(gram: np.ndarray, right: np.ndarray, count: int, regularisation: float) -> list[float]:
    whole = gram + regularisation * count * np.eye(len(right))
    return np.linalg.lstsq(whole, right, rcond=None)[0].tolist()


def fold_in_users(
    ratings: DataFrame, item_factors: DataFrame, user: str, item: str, rating: str, regularisation: float, most: int = RATINGS
) -> DataFrame:
    """Factors ``(id, features)`` of the users of these ratings from the stored factors of the items.

    Items without a factor are skipped, users without any such item have no row. Repeated ratings count each time, as in
    training.
    """
    factors = item_factors.select(F.col("id").alias(item), F.col("features").cast("array<double>").alias("v"))
    rows = ratings.where(F.col(user).isNotNull() & F.col(rating).isNotNull()).select(F.col(user).cast("long").alias("user"), item, F.col(rating).cast("double").alias("r"))
    joined = materialise(join_lookup(rows, factors, [item], "inner").select("user", "r", "v").withColumn("row", F.monotonically_increasing_id()))
    counts = joined.groupBy("user").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts"))
    dealt = join_lookup(joined, counts, ["user"], "inner", derived=True).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    ordered = dealt.repartition("user", "part").sortWithinPartitions("user", "part").select("user", "part", "parts", "r", "v")
    schema = pa.schema([("user", pa.int64()), ("n", pa.int64()), ("features", pa.list_(pa.float64())), ("gram", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def done() -> dict:
            gram, right, count = held
            if key[2] == 1:
                return {"user": key[0], "n": count, "features": _solved(gram, right, count, regularisation)}
            return {"user": key[0], "n": count, "gram": gram.ravel().tolist(), "right": right.tolist()}

        for batch in batches:
            out = []
            if batch.num_rows:
                v, r = _rows(batch["v"]), batch["r"].to_numpy()
                keys = np.stack([batch[c].to_numpy() for c in ("user", "part", "parts")], 1)
                cuts = np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(1)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(r)], strict=True):
                    part = (v[a:b].T @ v[a:b], v[a:b].T @ r[a:b], b - a)
                    now = tuple(keys[a].tolist())
                    if now == key:
                        held = tuple(x + y for x, y in zip(held, part, strict=True))
                    else:
                        if key is not None:
                            out.append(done())
                        key, held = now, part
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    found = materialise(ordered.mapInArrow(sums, "user long, n long, features array<double>, gram array<double>, right array<double>"))

    def together(group: pa.Table) -> pa.Table:
        right = _rows(group["right"].combine_chunks()).sum(0)
        gram = _rows(group["gram"].combine_chunks()).sum(0).reshape(len(right), -1)
        features = _solved(gram, right, int(np.sum(group["n"].to_numpy())), regularisation)
        return pa.table([group["user"][:1].combine_chunks(), pa.array([features], pa.list_(pa.float64()))], ["id", "features"])

    whole = found.where("gram IS NULL").select(F.col("user").alias("id"), "features")
    # As many rows as a user's ratings make parts.
    return whole.unionByName(found.where("gram IS NOT NULL").groupBy("user").applyInArrow(together, "id long, features array<double>"))
