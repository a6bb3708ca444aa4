"""Quality classifier by positive-unlabelled learning.

Documents become counts and ratios over their whole text, each put into one of ten quantile bins. A linear score
over the bins minimises the non-negative unbiased risk ``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))``
with trusted positives, unlabelled documents and the class prior ``p``, estimated as the smoothed share of label 1
among labelled documents. A logistic curve fitted to the same labelled documents turns the score into a probability.

Learning takes at most ``SAMPLE`` labelled and ``SAMPLE`` unlabelled documents, chosen by hash; scoring is one pass
over all texts without a shuffle. Only the text decides a score.

Cases: null texts count as empty; labels that are null are left out; an id with several labels counts once for
each; without any label or with one class only, every document gets the prior (0.5 without labels). Other columns
pass unchanged but for one of the name given to the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays
from reviewlens.plans.sizing import materialise, small_side

U = np.uint64
SAMPLE = 20_000
BINS = 10
CODES = np.arange(256)
LETTER = ((CODES | 32) >= 97) & ((CODES | 32) <= 122) | (CODES >= 128)
CLASSES = {
    "letters": LETTER, "upper": (CODES >= 65) & (CODES <= 90), "digits": (CODES >= 48) & (CODES <= 57),
    "lines": CODES == 10, "stops": np.isin(CODES, [33, 46, 63]), "commas": np.isin(CODES, [44, 58, 59]),
    "marks": ~LETTER & (CODES > 32) & ~((CODES >= 48) & (CODES <= 57)) & ~np.isin(CODES, [33, 44, 46, 58, 59, 63]),
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of measures per text."""
    size = np.diff(offsets).astype(float)
    share = lambda part, whole: part / np.maximum(whole, 1)
    sums = {n: np.concatenate([[0], np.cumsum(table[data])]) for n, table in CLASSES.items()}
    per_text = {n: np.diff(s[offsets]) for n, s in sums.items()}
    starts, ends, hashes, firsts = arrays.words(data, offsets)
    count = np.diff(firsts)
    owner = np.repeat(np.arange(len(count)), count)
    total = lambda values: np.bincount(owner, values, len(count))
    length = (ends - starts).astype(float)
    inside = {n: sums[n][ends] - sums[n][starts] for n in ("letters", "upper", "marks", "stops")}
    mean = share(total(length), count)
    spread = np.sqrt(np.maximum(share(total(length**2), count) - mean**2, 0))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(of.astype(U) << U(53) | values >> U(11))
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        runs, who = np.diff(np.append(new, len(keys))), (keys[new] >> U(53)).astype(np.int64)
        most = np.zeros(len(count))
        np.maximum.at(most, who, runs)
        return np.bincount(who, minlength=len(count)), most

    kinds, most = distinct(hashes, owner)
    threes, of = arrays.shingles(hashes, firsts, 3)
    three_kinds, three_most = distinct(threes, of)
    many = np.bincount(of, minlength=len(count))
    columns = [
        np.log1p(size), np.log1p(count), mean, spread, share(total(length > 20), count),
        *[share(per_text[n], size) for n in CLASSES], share(per_text["stops"], count), share(size, per_text["lines"] + 1),
        share(total(inside["letters"] == 0), count), share(total((inside["upper"] > 1) & (2 * inside["upper"] >= inside["letters"])), count),
        share(total(inside["marks"] > 0), count), share(total(inside["stops"] > 1), count), share(total(again), count),
        share(kinds, count), share(kinds, count**0.75), share(most, count), share(three_kinds, many), share(three_most, many),
    ]
    return np.stack(columns, 1)


@dataclass
class Model:
    """Bin edges per measure, a weight per bin, and the curve from scores to probabilities."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        return at + np.arange(len(self.edges)) * BINS

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit(labelled: np.ndarray, labels: np.ndarray, unlabelled: np.ndarray, turns: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk by gradient steps (Adam); step back along the estimate where it is negative."""
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        edges = np.zeros((labelled.shape[1], BINS - 1))
        return Model(edges, np.zeros(edges.shape[0] * BINS), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    both = np.concatenate([labelled, unlabelled])
    model = Model(np.quantile(both, np.arange(1, BINS) / BINS, axis=0).T, np.zeros(both.shape[1] * BINS), 0.0, 1.0, 0.0)
    positive, other = model.bins(labelled[labels == 1]), model.bins(unlabelled if len(unlabelled) else labelled)
    weights = np.zeros(len(model.weights) + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)

    def pulled(at: np.ndarray, slope: np.ndarray) -> np.ndarray:
        flat = np.bincount(at.ravel(), np.repeat(slope, at.shape[1]), len(weights) - 1)
        return np.append(flat, slope.sum()) / len(at)

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for turn in range(1, turns + 1):
        p, u = sigmoid(weights[positive].sum(1) + weights[-1]), sigmoid(weights[other].sum(1) + weights[-1])
        # The sigmoid loss: 1 - s for a positive, s for a negative; its slope is s (1 - s).
        hidden = u.mean() - prior * p.mean()
        negative = pulled(other, u * (1 - u)) - prior * pulled(positive, p * (1 - p))
        step = -prior * pulled(positive, p * (1 - p)) + negative if hidden >= 0 else -negative
        step[:-1] += decay * weights[:-1]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        weights -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    model.weights, model.bias = weights[:-1], float(weights[-1])
    z, y = model.margin(labelled), labels.astype(float)
    middle, wide = z.mean(), z.std() + 1e-9
    z, curve = (z - middle) / wide, np.zeros(2)
    for _ in range(50):  # Newton steps with a little shrinkage
        s = sigmoid(curve[0] * z + curve[1])
        h = s * (1 - s)
        grad = np.array([((s - y) * z).sum() + 0.1 * curve[0], (s - y).sum()])
        curve -= np.linalg.solve(np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]]), grad)
    model.slope, model.shift = float(curve[0] / wide), float(curve[1] - curve[0] * middle / wide)
    return model


def held_out(id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the documents outside the held-out fold."""
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(~held_out(F.col("id")) & F.col("id").isNotNull())
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    ids = texts.select("id")
    order = F.xxhash64("id", F.lit(7)), F.col("id")
    marked = ids.join(marks, "id").orderBy(*order).limit(sample)
    plain = ids.select("id", F.lit(-1).alias("y")).orderBy(*order).limit(sample)
    chosen = materialise(marked.union(plain))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                x = features(*arrays.utf8(part["text"]))
                yield pa.RecordBatch.from_pydict({"id": part["id"], "x": pa.array(list(x), pa.list_(pa.float64()))})

    wanted = texts.join(small_side(chosen.select("id").distinct()), "id", "left_semi")
    measured = wanted.mapInArrow(measure, arrays.with_fields(texts.select("id").schema, x="array<double>"))
    rows = measured.join(chosen, "id").orderBy("id", "y").toArrow()
    y = rows["y"].to_numpy()
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, width) if rows.num_rows else np.zeros((0, width))
    return fit(x[y >= 0], y[y >= 0], x[y < 0])


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in the column ``name``."""
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text):
                value = model.score(features(*arrays.utf8(part[text])))
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], pa.array(value)], [*kept, name])

    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    return plain.mapInArrow(run, arrays.with_fields(plain.schema, **{name: "double"}))
