"""Embedding near-dedup by an epsilon grid order join.

Two vectors of a label link when their cosine is at least ``least``; for unit vectors that is a distance of at
most ``epsilon``. Unit vectors are projected on leading principal axes, which never lengthens a distance, and put
in the order of grid cells of side ``epsilon``. Runs of this sequence are blocks with bounding boxes. Blocks whose
boxes are further apart than ``epsilon`` are skipped; the others are joined by halving the longer interval until
it is skipped or small enough for a product in double precision. The axes come from a bounded sample
(``SAMPLE`` vectors, by hash); they only decide how much can be skipped.

Equal vectors are one class, counted by its size. A task returns numbers of links and a spanning forest, never
the links, so a large group of near copies costs its products but no output.

Cases: a null label, and a null, empty or zero vector or one with null or non-finite parts, links with nothing;
vectors of different lengths don't link; rows with one id are separate vectors; the smallest id of null ids is
null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays
from reviewlens.llm.graph import components, forest
from reviewlens.plans.sizing import materialise

AXES = 3
SAMPLE = 20_000
BLOCK = 512
LEAF = 64
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def principal_axes(rows: np.ndarray, count: int = AXES) -> np.ndarray:
    """The leading axes of these unit vectors, as columns."""
    rows = rows - rows.mean(0)
    _, vectors = np.linalg.eigh(rows.T @ rows)
    return np.ascontiguousarray(vectors[:, ::-1][:, :count])


class Axes(dict):
    """Axes by the vectors' length; those of the coordinates for lengths the sample doesn't have."""

    def __missing__(self, dim: int) -> np.ndarray:
        return np.eye(dim)[:, :AXES]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _box_gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return float(np.sqrt((gap * gap).sum()))


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows of two sequence intervals (``same``: of one, each pair once)."""
    epsilon = np.sqrt(2 - 2 * least) + SLACK
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or (same and d <= a) or _box_gap(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0)) > epsilon:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            i, j = i + a, j + c
            keep = i < j if same else slice(None)
            yield i[keep], j[keep]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _pack(axes: Axes):
    """Runs of the sorted sequence as rows of one block each, with the block's bounding box."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch["label"].to_numpy(), batch["dim"].to_numpy()
            cuts = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(label)], strict=True):
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    place = unit(_vectors(part["v"])) @ axes[int(dim[at])]
                    yield pa.RecordBatch.from_pydict({
                        "label": part["label"][:1], "dim": part["dim"][:1],
                        "low": [place.min(0).tolist()], "high": [place.max(0).tolist()],
                        "node": pa.array([part["node"].to_pylist()], pa.list_(pa.int64())), "size": pa.array([part["size"].to_pylist()], pa.list_(pa.int64())),
                        "v": pa.array([part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary()),
                    })

    return pack


def _join(axes: Axes, least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def join(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        first = 0 if group["block"][0].as_py() == group["p"][0].as_py() else group.num_rows - 1
        sides = [first] if group.num_rows == 1 else [first, 1 - first]
        rows = [unit(np.frombuffer(group["v"][i].as_py(), np.float64).reshape(-1, dim)) for i in sides]
        node = [np.array(group["node"][i].as_py()) for i in sides]
        size = [np.array(group["size"][i].as_py()) for i in sides]
        x, y = rows[0], rows[-1]
        links = [np.zeros(len(r), np.int64) for r in rows]
        edges = [np.zeros((2, 0), np.int64)]
        for i, j in join_intervals(x, x @ axes[dim], y, y @ axes[dim], least, len(sides) == 1):
            np.add.at(links[0], i, size[-1][j])
            np.add.at(links[-1], j, size[0][i])
            a, b = node[0][i], node[-1][j]
            if len(a):
                edges.append(np.stack([a, b]))
                if sum(e.shape[1] for e in edges) > 1 << 16:
                    edges = [np.stack(forest(*np.concatenate(edges, 1)))]
        spots, roots = forest(*np.concatenate(edges, 1))
        tied = spots != roots
        counted = [(n[c > 0], c[c > 0]) for n, c in zip(node, links, strict=True)]
        a = np.concatenate([spots[tied], *[n for n, _ in counted]])
        b = pa.concat_arrays([pa.array(roots[tied], pa.int64()), pa.nulls(len(a) - tied.sum(), pa.int64())])
        c = np.concatenate([np.zeros(tied.sum(), np.int64), *[c for _, c in counted]])
        return pa.table([pa.array(a, pa.int64()), b, pa.array(c, pa.int64())], schema=schema)

    return join


def near_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """Per row: ``id``, ``n_links``, ``component_id`` (smallest id reachable) and ``kept`` (``id`` is that one)."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "v")))
    classes = materialise(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )
    sample = classes.select("dim", "v", "node").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow()
    axes = Axes()
    for dim in np.unique(sample["dim"].to_numpy()):
        axes[int(dim)] = principal_axes(unit(_vectors(sample.filter(pc.equal(sample["dim"], dim))["v"].combine_chunks())))
    epsilon = float(np.sqrt(2 - 2 * least) + SLACK)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            place = np.zeros((batch.num_rows, AXES))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                got = unit(_vectors(batch["v"].take(pa.array(mine)))) @ axes[int(dim)]
                place[mine, : got.shape[1]] = got
            columns = [pa.array(np.floor(place[:, i] / epsilon).astype(np.int32)) for i in range(AXES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(place[:, 0])], [*batch.schema.names, *[f"c{i}" for i in range(AXES)], "x"])

    order = ["label", "dim", *[f"c{i}" for i in range(AXES)], "x", "node"]
    kind = arrays.with_fields(classes.drop("rep").schema, **{c: "int" for c in order[2:-2]}, x="double")
    celled = materialise(classes.drop("rep").mapInArrow(cells, kind))
    kind = "label long, dim int, low array<double>, high array<double>, node array<long>, size array<long>, v binary"
    blocks = celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(axes), kind)
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()))
    cell = lambda c, i: F.floor(F.col(c)[i] / epsilon)
    boxes = blocks.select("block", "label", "dim", "low", "high")
    left = boxes.select(*[F.col(c).alias(f"l_{c}") for c in ("block", "low", "high")], "label", "dim", F.explode(F.sequence(cell("low", 0) - 1, cell("high", 0) + 1)).alias("at"))
    right = boxes.select("*", F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("at"))
    gaps = F.zip_with(F.zip_with("low", "l_high", lambda a, b: a - b), F.zip_with("l_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    near = left.join(right, ["label", "dim", "at"]).where((F.col("l_block") <= F.col("block")) & (apart <= epsilon * epsilon))
    pairs = near.select(F.col("l_block").alias("p"), F.col("block").alias("q")).distinct()
    dealt = pairs.withColumn("block", F.explode(F.array_distinct(F.array("p", "q")))).join(blocks.select("block", "dim", "node", "size", "v"), "block")
    found = materialise(dealt.groupBy("p", "q").applyInArrow(_join(axes, least), "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    tied = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "rep", "size").join(tied.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = named.join(least_id, "component").join(links.withColumnRenamed("a", "node"), "node", "left")
    known = known.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    result = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return result.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
