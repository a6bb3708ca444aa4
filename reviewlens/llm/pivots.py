"""Exact top-k inner products by elimination over a table of pivot distances.

Scores are inner products of integer vectors. With the distance to every pivot known for query and row, the triangle
inequality gives ``d(q, r) >= max |d(q, p) - d(r, p)|`` over the pivots, and since the product is
``(|q|^2 + |r|^2 - d(q, r)^2) / 2``, an upper bound of the score. Rows are evaluated in the order of their bounds until the
next bound is below the k-th score found; bounds carry a margin for rounding, scores are computed in 64-bit integers.

Equal vectors are one class, which keeps its ``k + 1`` smallest ids: no further one can be among the best ``k`` of a query.
Classes lie in the order of their nearest pivot and the distance to it; runs of this order are blocks with ranges
of all pivot distances, an index that is written once. A query vector first meets the block it lies in, which gives a
least score. Chunks of neighbouring queries then meet only the blocks whose ranges leave a bound of at least that, and
there the rows by their own bounds. Neither queries nor blocks are collected.

The pivots (``PIVOTS`` per length of vector, each the furthest from those before, the first one zero) come from a sample
of ``SAMPLE`` classes by hash; they decide how much is skipped, never what is found.

Cases: rows with a null id, with a null vector, or with null or non-finite components take no part, nor do vectors whose
squared length reaches 2**62. Vectors meet those of their own length only; empty ones have score 0. Rows equal
in id and vector count once; rows with one id and different vectors are rows of their own, as queries and as candidates.
Ties go to the smaller id. Without queries there is no result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.llm.negatives import integer_rows, matrix
from reviewlens.plans.sizing import materialise

PIVOTS = 32
SAMPLE = 2048
# Vectors of a block, queries of a chunk; blocks that a task evaluates, and blocks and chunks whose ranges it compares.
BLOCK = 256
CHUNK = 64
BLOCKS = 64
RANGES = 2048
FIRST = 64
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min


def choose_pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Zero, then each time the row furthest from those chosen; fewer if all rows are chosen."""
    chosen = np.zeros((1, rows.shape[1]))
    nearest = np.sqrt((rows * rows).sum(1))
    while len(chosen) < count and len(rows) and nearest.max() > 0:
        chosen = np.vstack([chosen, rows[nearest.argmax()]])
        nearest = np.minimum(nearest, np.sqrt(((rows - chosen[-1]) ** 2).sum(1)))
    return chosen


class Pivots(dict):
    """Pivots by the vectors' length; zero alone for lengths the sample doesn't have."""

    def __missing__(self, dim: int) -> np.ndarray:
        return np.zeros((1, dim))


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows to the pivots."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], 1)


def upper_bounds(gap: np.ndarray, reach: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The most an inner product can be: from a least distance, the sizes it was computed from, and the sum of squared lengths."""
    least = np.maximum(0, gap - SLACK * reach)
    return (squares * (1 + SLACK) - least * least * (1 - SLACK)) / 2 + 1


def best(scores: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` by score, highest first, then id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order], nodes[order]


def _pack(names: list[str]):
    """Runs of the sorted classes as one row each, with the ranges of their pivot distances."""

    def pack(size: int):
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dim = batch["dim"].to_numpy()
                cuts = np.flatnonzero(np.diff(dim)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(dim)], strict=True):
                    for at in range(a, b, size):
                        part = batch.slice(at, min(size, b - at))
                        far = part["far"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                        yield pa.RecordBatch.from_pydict({
                            "dim": part["dim"][:1], "low": pa.array([far.min(0).tolist()]), "high": pa.array([far.max(0).tolist()]),
                            **{n: pa.array([part[n].to_numpy().astype(np.int64).tobytes()], pa.binary()) for n in names},
                            "far": pa.array([far.astype(np.float64).tobytes()], pa.binary()),
                            "v": pa.array([part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                        })

        return packed

    return pack


def _whole(row: dict, names: list[str]) -> tuple[np.ndarray, ...]:
    """Vectors, pivot distances and whole numbers of a packed row."""
    numbers = [np.frombuffer(row[n], np.int64) for n in names]
    count = len(numbers[0])
    return np.frombuffer(row["v"], np.int64).reshape(count, -1), np.frombuffer(row["far"], np.float64).reshape(count, -1), *numbers


def search(
    query: np.ndarray, far: np.ndarray, least: int, rows: np.ndarray, table: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best ``k`` rows for a query with scores of at least ``least``, and how many rows were evaluated.

    Column 0 of the pivot distances is the length of a vector.
    """
    gap, reach = np.abs(table - far).max(1), table.max(1) + far.max()
    bound = upper_bounds(gap, reach, table[:, 0] ** 2 + far[0] ** 2)
    order = np.flatnonzero(bound >= least)
    order = order[np.argsort(-bound[order])]
    found = (np.zeros(0, np.int64),) * 3
    at, step = 0, FIRST
    while at < len(order) and (len(found[0]) < k or bound[order[at]] >= found[0][-1]):
        some = order[at : at + step]
        scores = rows[some] @ query
        keep = scores >= least
        found = best(*(np.concatenate(p) for p in zip(found, (scores[keep], ids[some][keep], nodes[some][keep]), strict=True)), k)
        at, step = at + step, 2 * step
    return *found, min(at, len(order))


def _seed(k: int):
    """For the query vectors of a block: the k-th score in it, or the least number if it holds fewer rows."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, far, node, asked = _whole({c: batch[c][i].as_py() for c in ("v", "far", "node", "asked")}, ["node", "asked"])
                mine = np.flatnonzero(asked)
                if not len(mine):
                    continue
                scores = rows[mine] @ rows.T
                least = np.partition(scores, -k, 1)[:, -k] if len(rows) >= k else np.full(len(mine), LEAST)
                dim = rows.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(node[mine]), "dim": pa.array(np.full(len(mine), dim, np.int32)), "least": pa.array(least),
                    "v": pa.array(list(rows[mine]), pa.list_(pa.int64())), "far": pa.array(list(far[mine]), pa.list_(pa.float64())),
                })

    return seed


def _meetings():
    """Chunks and blocks whose ranges leave a bound that some query's least score allows."""
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int64())])

    def meet(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        if not (blocks.num_rows and chunks.num_rows):
            return schema.empty_table()
        low, high = (np.stack(blocks[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("low", "high"))
        number, out = blocks["block"].to_numpy(), []
        for i in range(chunks.num_rows):
            far = np.frombuffer(chunks["far"][i].as_py(), np.float64).reshape(-1, low.shape[1])
            least = np.frombuffer(chunks["least"][i].as_py(), np.int64)
            open_ = np.zeros(len(number), bool)
            for q, wanted in zip(far, least, strict=True):
                gap = np.maximum(0, np.maximum(low - q, q - high)).max(1)
                open_ |= upper_bounds(gap, high.max(1) + q.max(), high[:, 0] ** 2 + q[0] ** 2) >= wanted
            out.append(np.stack([np.full(open_.sum(), chunks["chunk"][i].as_py()), number[open_]]))
        return pa.table(list(np.concatenate(out, 1)), schema=schema)

    return meet


def _evaluate(k: int):
    schema = pa.schema([(n, pa.int64()) for n in ("query", "score", "id", "node")])

    def evaluate(blocks: pa.Table, chunk: pa.Table) -> pa.Table:
        if not (blocks.num_rows and chunk.num_rows):
            return schema.empty_table()
        parts = [_whole(r, ["rep", "node"]) for r in blocks.select(["v", "far", "rep", "node"]).to_pylist()]
        rows, table, ids, nodes = (np.concatenate(p) for p in zip(*parts, strict=True))
        vectors, far, asked, least = _whole(chunk.select(["v", "far", "node", "least"]).to_pylist()[0], ["node", "least"])
        out = [np.zeros((4, 0), np.int64)]
        for v, f, node, wanted in zip(vectors, far, asked, least, strict=True):
            scores, found, places, _ = search(v, f, wanted, rows, table, ids, nodes, k)
            out.append(np.stack([np.full(len(scores), node), scores, found, places]))
        return pa.table(list(np.concatenate(out, 1)), schema=schema)

    return evaluate


def top_products(
    vectors: DataFrame, asked: Column, *, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, k: int = 10
) -> DataFrame:
    """The ``k`` rows of another id with the largest inner products, for every row where ``asked`` holds.

    Per row: ``query_id``, ``rank`` from 1, ``id`` (under its own name) and ``score``.
    """
    rows = integer_rows(vectors, id, vector, scale, asked=F.coalesce(asked, F.lit(False)))
    rows = materialise(rows.groupBy("id", "v", "dim").agg(F.max("asked").alias("asked")))
    # One more than asked for, as the query itself may be among them.
    most = k + 1
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    first = rows.select("v", "dim", "id").withColumn("place", place).where(F.col("place") <= most)
    classes = first.groupBy("v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    wanted = rows.where("asked").select("v").distinct().withColumn("asked", F.lit(1))
    classes = classes.join(wanted, "v", "left").withColumn("asked", F.coalesce("asked", F.lit(0)).cast("long"))
    classes = materialise(classes.withColumn("rep", F.col("ids")[0]).withColumn("node", F.monotonically_increasing_id()))

    sample = classes.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    pivots = Pivots()
    for dim in np.unique(sample["dim"].to_numpy()):
        pivots[int(dim)] = choose_pivots(matrix(sample.filter(pc.equal(sample["dim"], dim))["v"], int(dim)).astype(np.float64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                far = pivot_distances(matrix(pa.chunked_array([part["v"]]), int(dim)).astype(np.float64), pivots[int(dim)])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(far), pa.list_(pa.float64())), pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))],
                    [*part.schema.names, "far", "near", "gap"],
                )

    kind = "v array<long>, dim int, node long, rep long, asked long, far array<double>, near int, gap double"
    order = ["dim", "near", "gap", "node"]
    placed = materialise(classes.select("v", "dim", "node", "rep", "asked").mapInArrow(measured, kind))
    ranges = "dim int, low array<double>, high array<double>"
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack(["node", "rep", "asked"])(BLOCK), f"{ranges}, node binary, rep binary, asked binary, far binary, v binary")
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()))

    seeds = blocks.select("v", "far", "node", "asked").mapInArrow(_seed(most), "node long, dim int, least long, v array<long>, far array<double>")
    # Neighbours in the order of the index share a chunk.
    nearest = F.array_position("far", F.array_min("far"))
    near = [F.col("dim"), nearest, F.array_min("far"), F.col("node")]
    chunks = seeds.repartitionByRange(*near).sortWithinPartitions(*near).mapInArrow(
        _pack(["node", "least"])(CHUNK), f"{ranges}, node binary, least binary, far binary, v binary")
    chunks = materialise(chunks.withColumn("chunk", F.monotonically_increasing_id()))

    groups = [-(-max(1, t.count()) // RANGES) for t in (blocks, chunks)]
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.select("dim", "block", "low", "high").withColumn("p", slot("block", groups[0])).withColumn("q", every(groups[1]))
    right = chunks.select("dim", "chunk", "far", "least").withColumn("q", slot("chunk", groups[1])).withColumn("p", every(groups[0]))
    met = left.groupBy("dim", "p", "q").cogroup(right.groupBy("dim", "p", "q")).applyInArrow(_meetings(), "chunk long, block long")

    parts = -(-max(1, blocks.count()) // BLOCKS)
    met = materialise(met.withColumn("part", slot("block", parts)))
    sent = met.join(blocks.select("block", "v", "far", "rep", "node"), "block").drop("block")
    asking = met.select(F.col("chunk").alias("chunk"), F.col("part").alias("part")).distinct().join(chunks.select("chunk", "v", "far", "node", "least"), "chunk")
    found = sent.groupBy("chunk", "part").cogroup(asking.groupBy("chunk", "part")).applyInArrow(_evaluate(most), "query long, score long, id long, node long")

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    nodes = found.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "score", "node")
    named = nodes.join(classes.select("node", "ids"), "node").select("query", "score", "node", F.explode("ids").alias("id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    listed = named.withColumn("rank", rank).where(F.col("rank") <= most)
    asking = rows.where("asked").select(F.col("id").alias("query_id"), "v").join(classes.select("v", F.col("node").alias("query")), "v").drop("v")
    others = asking.join(listed.select("query", "score", "id", "node"), "query").where("id <> query_id OR node <> query")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
