"""Hard-negative mining by Strassen products of integer tiles.

Scores are inner products of integer vectors. An anchor's positives are the best rows of its label; its hard negatives
for a positive are the best rows of other labels in a window of scores below the positive's. Anchors and rows are dealt
into tiles, and each tile is multiplied by Strassen's recursion: operands are padded with zeros to even sides and
halved until a side is at most ``LEAF``. Additions and products are those of 64-bit integers, which form a ring, so a
score that fits in 64 bits is exact whatever the sums in between.

A tile passes on heaps only: an anchor's best rows of its label in the first pass, and for each of its positives the best
rows inside the window in the second. Heaps of the tiles merge to those of the table, since a row among the best
overall is among the best of its tile. The first pass multiplies rows of one label only. Work is dealt by row, not by
id or label: one label or id with a third of all rows is as many tiles as its rows make.

Cases: rows with a null id or label, with a null vector, or with null or non-finite components take no part, nor do
vectors whose squared length reaches 2**62, whose scores need not fit in 64 bits. Empty vectors have score 0; vectors meet
those of their own length only. Rows with one id are rows of their own: each can be an anchor, and a row's others are all rows but
itself. Ties go to the smaller id. Without anchors or rows there is no result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.plans.sizing import join_lookup, materialise

LEAF = 32
# Anchors and rows of a tile, and anchors that are multiplied at a time.
ANCHORS = 1024
ROWS = 4096
STEP = 128


def integer_rows(vectors: DataFrame, id: str, vector: str, scale: int, **more: Column) -> DataFrame:
    """``id``, the integer vector ``v = floor(scale * x)`` and ``dim`` of the rows that take part, with more columns."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double")).alias("x"), *[c.alias(n) for n, c in more.items()])
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    short = F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)) < float(2**62)
    usable = F.col("id").isNotNull() & F.coalesce(finite & short, F.lit(False))
    return rows.where(usable).select("id", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"), F.size("x").alias("dim"), *more)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows of 64-bit integers."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), dim)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices by seven products of their halves."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        return a @ b
    a = np.pad(a, [(0, rows % 2), (0, inner % 2)])
    b = np.pad(b, [(0, inner % 2), (0, columns % 2)])
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def _products(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The place of an anchor and its scores with all rows."""
    dim = anchors["dim"][0].as_py()
    left, right = matrix(anchors["v"], dim), np.ascontiguousarray(matrix(rows["v"], dim).T)
    for at in range(0, len(left), STEP):
        for i, scores in enumerate(strassen(left[at : at + STEP], right), at):
            yield i, scores


def _best_positives(count: int):
    schema = pa.schema([("row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def best(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (rows.num_rows and anchors.num_rows):
            return schema.empty_table()
        rows = rows.sort_by("id")
        number, ids = rows["row"].to_numpy(), rows["id"].to_numpy()
        out = [np.zeros((3, 0), np.int64)]
        for i, scores in _products(anchors, rows):
            own = anchors["row"][i].as_py()
            least = np.partition(scores, -count - 1)[-count - 1] if len(scores) > count else scores.min()
            at = np.flatnonzero((scores >= least) & (number != own))
            at = at[np.argsort(-scores[at], kind="stable")][:count]
            out.append(np.stack([np.full(len(at), own), ids[at], scores[at]]))
        return pa.table(list(np.concatenate(out, 1)), schema=schema)

    return best


def _best_negatives(count: int, percent: int):
    schema = pa.schema([(n, pa.int64()) for n in ("row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")])

    def best(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (rows.num_rows and anchors.num_rows):
            return schema.empty_table()
        rows = rows.sort_by("id")
        label, ids = rows["label"].to_numpy(), rows["id"].to_numpy()
        own, named, labels, positives = (anchors[c].to_pylist() for c in ("row", "id", "label", "positives"))
        out = [np.zeros((7, 0), np.int64)]
        for i, scores in _products(anchors, rows):
            # The least whole score of each window, without a product that could overflow.
            windows = [(p["positive_score"], -(-percent * p["positive_score"] // 100)) for p in positives[i]]
            low, high = min(w[1] for w in windows), max(w[0] for w in windows)
            at = np.flatnonzero((scores >= low) & (scores <= high) & (label != labels[i]))
            at = at[np.argsort(-scores[at], kind="stable")]
            ordered = scores[at]
            for place, ((top, bottom), positive) in enumerate(zip(windows, positives[i], strict=True)):
                first = np.searchsorted(-ordered, -top)
                chosen = at[first : first + count]
                chosen = chosen[scores[chosen] >= bottom]
                fixed = np.repeat([[own[i]], [named[i]], [place], [positive["positive_id"]], [top]], len(chosen), 1)
                out.append(np.concatenate([fixed, [ids[chosen], scores[chosen]]]))
        return pa.table(list(np.concatenate(out, 1)), schema=schema)

    return best


def _tiles(rows: DataFrame, anchors: DataFrame, keys: list[str], work, kind: str) -> DataFrame:
    """``work`` on every tile of rows and anchors that agree in ``keys``."""
    count = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    totals = materialise(count(anchors, ANCHORS, "chunks").join(count(rows, ROWS, "parts"), keys))
    slot = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join_lookup(rows, totals, keys, "inner").withColumn("part", slot("parts")).withColumn("chunk", every("chunks"))
    right = join_lookup(anchors, totals, keys, "inner").withColumn("chunk", slot("chunks")).withColumn("part", every("parts"))
    group = [*keys, "part", "chunk"]
    return left.drop("chunks", "parts").groupBy(*group).cogroup(right.drop("chunks", "parts").groupBy(*group)).applyInArrow(work, kind)


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """The best ``negatives`` rows of other labels for each anchor and each of its best ``positives`` rows of its own label.

    Rows where ``anchor`` holds are anchors. A negative's score is at least ``percent`` hundredths of the positive's
    and at most the positive's. Per row: ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    rows = integer_rows(vectors, id, vector, scale, label=F.col(label).cast("long"), anchor=F.coalesce(anchor, F.lit(False)))
    rows = materialise(rows.where("label IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    # Names of its own, as both sides of a cogroup must have.
    asked = rows.where("anchor").select(*[F.col(c).alias(c) for c in ("id", "v", "dim", "label", "row")])
    rows = rows.drop("anchor")
    found = _tiles(rows, asked, ["label", "dim"], _best_positives(positives), "row long, positive_id long, positive_score long")
    order = F.row_number().over(W.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("place", order).where(F.col("place") <= positives)
    listed = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asked = materialise(asked.join(listed, "row"))
    kind = "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _tiles(rows, asked, ["dim"], _best_negatives(negatives, percent), kind)
    order = F.row_number().over(W.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    merged = found.withColumn("rank", order).where(F.col("rank") <= negatives)
    return merged.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
