"""Exact nearest neighbours of all vectors by cosine: cells around pivots and the triangle inequality.

The cosine of two vectors is ``1 - d^2 / 2`` for the distance ``d`` of their unit vectors. Every unit vector belongs to the cell
of its nearest pivot; runs of a cell in the order of the distance to the pivot are blocks, each with the least and
the largest of these distances. First every vector meets its own cell's block, which bounds the distance of its ``k``-th
neighbour. Then it meets the blocks only that can hold something nearer: a block is too far if the distance to its pivot
differs from all of the block's by more than the bound, or if the boundary of the two cells is further than that.

Blocks are dealt into chunks, and each pair of chunks of which blocks meet is one task's group: the vectors travel once per pair of chunks,
not once per pair of blocks, and a group passes on ``k`` matches per vector. There are about ``PARTS`` chunks, more where one would
hold over ``NUMBERS`` numbers or ``CHUNK`` vectors.

Pivots are a sample of at most ``PIVOTS`` vectors, about the square root of their number; they decide how much is skipped, never
what is found. Equal vectors are one class with its ``k + 1`` smallest ids. Zero and null vectors have cosine 0 with all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reviewlens.plans.scoring import DIGITS
from reviewlens.plans.sizing import materialise, small_side

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 1024
# Vectors of a block.
BLOCK = 256
# Chunks of blocks, and the numbers and vectors that one chunk holds at most.
PARTS = 8
NUMBERS = 2**21
CHUNK = 2**15
SCALE = 10**DIGITS
SLACK = 1e-6  # covers the rounding of cosines to DIGITS places and of distances

_FOUND = pa.schema([(n, pa.int64()) for n in ("query", "node", "rep", "score")])
_FOUND_DDL = "query long, node long, rep long, score long"
_BLOCK_DDL = "cell int, low double, high double, node binary, rep binary, v binary, least binary"
_MET_DDL = "source long, q_chunk int, chunk int, blocks array<long>, counts array<int>, asking binary"


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances between unit rows."""
    return np.sqrt(np.maximum(0, 2 - 2 * (rows @ others.T)))


def _reach(scores: np.ndarray) -> np.ndarray:
    """The distance that cosines of at least these whole scores don't exceed."""
    return np.sqrt(np.maximum(0, 2 - 2 * (scores / SCALE - SLACK)))


def _pack(k: int, stored: type):
    """Runs of one cell as rows of one block each, with the k-th score of every vector inside its block, the least possible if that holds fewer."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    away, rows = part["away"].to_numpy(), unit_rows(part["v"])
                    least = np.partition(_scores(rows, rows), -k, 1)[:, -k] if len(rows) >= k else np.full(len(rows), -2 * SCALE)
                    flat = part["v"].flatten().to_numpy(zero_copy_only=False).astype(stored)
                    binary = [pa.array([x.tobytes()], pa.binary()) for x in (part["node"].to_numpy(), part["rep"].to_numpy(), flat, least)]
                    yield pa.RecordBatch.from_arrays(
                        [part["cell"][:1], pa.array([away.min()]), pa.array([away.max()]), *binary], ["cell", "low", "high", "node", "rep", "v", "least"])

    return pack


def _unpacked(data: bytes, count: int, stored: type) -> np.ndarray:
    """The vectors of a block as unit rows."""
    rows = np.frombuffer(data, stored).reshape(count, -1).astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _best(nodes: np.ndarray, reps: np.ndarray, scores: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the places of the first ``k`` that are at least ``least``, by score, then id."""
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= least[i])
        if len(at) > k:
            at = at[row[at] >= np.partition(row[at], -k)[-k]]
        yield i, at[np.lexsort((reps[at], -row[at]))][:k]


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.rint((x @ y.T) * SCALE).astype(np.int64)


def _nearby(pivots: np.ndarray, blocks: list[np.ndarray], chunks: np.ndarray, stored: type):
    """For each block the other blocks, by chunk, that may hold something nearer to one of its vectors, with the places of these vectors."""

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, low, high = blocks
        apart = distances(pivots, pivots)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("block", "cell", "v", "least")}
                least = np.frombuffer(row["least"], np.int64)
                reach = _reach(least.astype(np.float64))
                far = distances(_unpacked(row["v"], len(least), stored), pivots)
                away = far[:, row["cell"]]
                # From a vector to the boundary with another cell.
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (far**2 - away[:, None] ** 2) / (2 * apart[row["cell"]])
                border[:, apart[row["cell"]] == 0] = 0
                ring = np.maximum(far[:, cell] - high, low - far[:, cell])
                near = np.maximum(ring, border[:, cell]) <= reach[:, None] + SLACK
                some = near.any(0)
                q_chunk = chunks[np.searchsorted(number, row["block"])]
                for chunk in np.unique(chunks[some]):
                    at = np.flatnonzero(some & (chunks == chunk))
                    yield pa.RecordBatch.from_pydict({
                        "source": pa.array([row["block"]], pa.int64()), "q_chunk": pa.array([q_chunk], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                        "blocks": pa.array([number[at]], pa.list_(pa.int64())), "counts": pa.array([near[:, at].sum(0).astype(np.int32)], pa.list_(pa.int32())),
                        "asking": pa.array([np.packbits(near[:, at]).tobytes()], pa.binary()),
                    })

    return nearby


def _meet(k: int, stored: type):
    """The best matches in the blocks of one chunk for the vectors of another that ask for them."""

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), np.int64)]
        # By place of the block: ids and vectors are unpacked once.
        nodes = {r["block"]: (np.frombuffer(r["node"], np.int64), np.frombuffer(r["rep"], np.int64), r["v"]) for r in held.select(["block", "node", "rep", "v"]).to_pylist()}
        vectors = {b: _unpacked(v, len(node), stored) for b, (node, _, v) in nodes.items()}
        for i in range(asked.num_rows):
            row = {c: asked[c][i].as_py() for c in ("blocks", "asking", "least", "q_node", "q_v")}
            query, least = np.frombuffer(row["q_node"], np.int64), np.frombuffer(row["least"], np.int64)
            rows, met = _unpacked(row["q_v"], len(query), stored), row["blocks"]
            near = np.unpackbits(np.frombuffer(row["asking"], np.uint8), count=len(query) * len(met)).reshape(len(query), -1).astype(bool)
            node, rep = (np.concatenate([nodes[b][c] for b in met]) for c in (0, 1))
            scores, at = np.full((len(query), len(node)), -3 * SCALE), 0
            for j, b in enumerate(met):
                size, some = len(vectors[b]), near[:, j]
                if some.all():
                    scores[:, at : at + size] = _scores(rows, vectors[b])
                else:
                    scores[some, at : at + size] = _scores(rows[some], vectors[b])
                at += size
            out += [np.stack([np.full(len(p), query[j]), node[p], rep[p], scores[j, p]]) for j, p in _best(node, rep, scores, least, k)]
        return pa.Table.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], schema=_FOUND)

    return meet


def _prepared(df: DataFrame, id_col: str, vector: str, k: int, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, type]:
    """Rows, classes of equal vectors, meetings of blocks, blocks with the k-th scores of their vectors, and the type of their numbers."""
    stored = np.float32 if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else np.float64
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialise(rows.withColumn("v", F.when(F.exists("v", lambda x: x != 0), F.col("v"))))
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    first = rows.where("v IS NOT NULL").withColumn("place", place).where(F.col("place") <= k)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(classes.withColumn("rep", F.col("ids")[0]).withColumn("node", F.monotonically_increasing_id()))
    count = min(pivots, int(np.sqrt(classes.count())) + 1)
    sample = classes.select("v", "node").orderBy(F.xxhash64("v"), "node").limit(count).toArrow()
    chosen = unit_rows(sample["v"].combine_chunks()) if sample.num_rows else np.zeros((1, 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(unit_rows(batch["v"]), chosen)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], [*batch.schema.names, "cell", "away"])

    kind = "v array<double>, rep long, node long, cell int, away double"
    order = ["cell", "away", "node"]
    celled = materialise(classes.select("v", "rep", "node").mapInArrow(placed, kind))
    blocks = celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(k, stored), _BLOCK_DDL)
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()))
    # Five numbers per block of BLOCK vectors.
    ranges = blocks.select("block", "cell", "low", "high", (F.octet_length("node") / 8).cast("long").alias("size")).toArrow().sort_by("block")
    listed = [ranges[c].to_numpy() for c in ("block", "cell", "low", "high")]
    upto = np.cumsum(ranges["size"].to_numpy())
    most = max(BLOCK, min(CHUNK, NUMBERS // max(1, chosen.shape[1]), -(-int(upto[-1]) // PARTS) if len(upto) else 0))
    chunks = ((upto - ranges["size"].to_numpy()) // most).astype(np.int32)
    met = materialise(blocks.select("block", "cell", "v", "least").mapInArrow(_nearby(chosen, listed, chunks, stored), _MET_DDL))
    return rows, classes, met, blocks, stored


def nearest_items(df: DataFrame, id_col: str, vector: str, k: int, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` other vectors closest to each vector: ``(query, id_col, cosine, rank)``.

    Compared as rounded; ties go to the smaller id. All vectors must have one length. ``id_col`` must identify a row.
    """
    # The vector itself is among the matches found.
    most = k + 1
    rows, classes, met, blocks, stored = _prepared(df, id_col, vector, most, pivots)
    asked = blocks.select(F.col("block").alias("source"), F.col("node").alias("q_node"), F.col("v").alias("q_v"), "least")
    asked = met.drop("counts").join(asked, "source")
    needed = met.select(F.col("q_chunk").alias("for_chunk"), F.col("chunk").alias("of_chunk"), F.explode("blocks").alias("block")).distinct()
    held = needed.join(blocks.select("block", "node", "rep", "v"), "block")
    found = asked.groupBy("q_chunk", "chunk").cogroup(held.groupBy("for_chunk", "of_chunk")).applyInArrow(_meet(most, stored), _FOUND_DDL)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))
    best = found.withColumn("place", rank).where(F.col("place") <= most).join(classes.select("node", "ids"), "node")
    listed = best.select("query", F.explode("ids").alias("id"), "score")
    # Vectors without length: the smallest ids stand for all of them.
    blank = rows.where("v IS NULL").orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id"))).scalar()
    zero = F.lit(0).cast("long").alias("score")
    listed = listed.unionByName(classes.select(F.col("node").alias("query"), F.explode(blank).alias("id"), zero))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    listed = listed.withColumn("place", rank).where(F.col("place") <= most).select("query", "id", "score")
    owners = rows.where("v IS NOT NULL").select(F.col("id").alias("asking"), "v").join(classes.select(F.col("v"), F.col("node").alias("query")), "v").drop("v")
    pairs = owners.join(listed, "query").select("asking", "id", "score")
    lowest = rows.orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id"))).scalar()
    pairs = pairs.unionByName(rows.where("v IS NULL").select(F.col("id").alias("asking"), F.explode(lowest).alias("id"), zero))
    rank = F.row_number().over(W.partitionBy("asking").orderBy(F.desc("score"), "id"))
    ranked = pairs.where("asking <> id").withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("asking").alias("query"), F.col("id").alias(id_col), (F.col("score") / F.lit(SCALE)).alias("cosine"), "rank")


def products_done(df: DataFrame, id_col: str, vector: str, k: int, pivots: int = PIVOTS) -> DataFrame:
    """One row: ``products`` of two vectors that :func:`nearest_items` multiplies, ``vectors`` (different ones) and ``pivots`` products."""
    _, classes, met, blocks, _ = _prepared(df, id_col, vector, k + 1, pivots)
    sizes = blocks.select("block", (F.octet_length("node").cast("long") / 8).alias("size"))
    pairs = met.select(F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("counts").alias("asking"))))
    joined = pairs.join(small_side(sizes), "block")
    own = sizes.agg(F.sum(F.col("size") * F.col("size"))).scalar()
    return joined.agg((F.sum(F.col("asking") * F.col("size")) + own).cast("long").alias("products")).withColumn("vectors", classes.agg(F.count("*")).scalar())
