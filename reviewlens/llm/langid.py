"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; letters stay, runs of anything else are one space. Every language has a model of
character 4-grams: counts of the training folds for the highest order, numbers of distinct left neighbours below,
one discount per order, interpolated down to a uniform guess. A text goes to the language with the lowest
cross-entropy per character.

Counting covers every document of the folds but 2 and keeps every 4-gram; orders, discounts and probabilities are Spark
tables. The log-probability of a character is a sum over the orders: the weight of backing off from its context,
where the language has it, and the gain of its n-gram over that, where the language has it. So the model is one
table of such numbers by 64-bit hash and language that grows with the corpus. Up to ``PART`` of them are one broadcast;
a larger model is taken a range of hashes at a time, and the sums of the ranges are added per row.

Calibration uses one document each of at most ``SAMPLE`` ids of fold 1, measured by a model that has not counted these
ids; then they are counted as well. It gives a logistic curve from the lead over the second language to the chance of
being right, and the spread of cross-entropies per language; texts beyond it, or with a low chance, are ``rejected``.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language by name;
without labelled text everything is ``und``. Null labels are left out. Ids may repeat. Other columns pass unchanged
but for ones named like the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm import arrays
from reviewlens.plans.sizing import materialise, small_side

U = np.uint64
ORDER = 4
PART = 4_000_000
SAMPLE = 20_000
HELD = 2_000_000
IS_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
MASK = [U((1 << 16 * m) - 1) if m < 4 else ~U(0) for m in range(5)]
CONTEXT = 8  # added to the order in hashes of contexts
RESULTS = ("lang_pred", "score", "rejected")


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of the letters and spaces of all texts, and where each begins."""
    lower = [(t or "").lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower], dtype=np.int64)])
    flat = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    far = flat > 0xFFFF
    if far.any():
        flat = flat.copy()
        kinds, at = np.unique(flat[far], return_inverse=True)
        flat[far] = np.array([0xAC00 + int(c) % 0x2BA0 if chr(c).isalpha() else 32 for c in kinds], np.uint32)[at]
    letter = IS_LETTER[flat]
    keep = letter.copy()
    border = np.zeros(len(flat) + 1, bool)
    border[offsets] = True
    keep[1:] |= ~letter[1:] & letter[:-1] & ~border[1:-1]
    return np.where(letter, flat, 32)[keep].astype(U), np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per character itself behind the three before it (spaces ahead of the text), packed into a word."""
    place = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
    packed = values.copy()
    for back in range(1, ORDER):
        before = np.full(len(values), 32, U)
        before[back:] = values[:-back] if len(values) > back else values[:0]
        packed |= np.where(place >= back, before, U(32)) << U(16 * back)
    return packed


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
        counts = np.ones(len(keys), np.int64)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-grams per language and ``held``, summed within the task as far as memory allows."""
    sums: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def emit(kind: tuple[str, bool]) -> pa.RecordBatch:
        parts = sums.pop(kind)
        keys, counts = tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        lang, held = (pa.array([x] * len(keys)) for x in kind)
        return pa.RecordBatch.from_arrays([lang, held, pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "held", "key", "n"])

    for batch in batches:
        for part in arrays.slices(batch, "text"):
            kinds = list(zip(part["lang"].to_pylist(), part["held"].to_pylist(), strict=True))
            for kind in sorted(set(kinds)):
                texts = part["text"].take(pa.array([i for i, k in enumerate(kinds) if k == kind])).to_pylist()
                parts = sums.setdefault(kind, [])
                parts.append(tally(grams(*codes(texts))))
                if len(parts) > 1 and len(parts[-1][0]) + sum(len(k) for k, _ in parts[1:-1]) > len(parts[0][0]):
                    parts[:] = [tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
        if sum(len(k) for parts in sums.values() for k, _ in parts) > HELD:
            for kind in list(sums):
                yield emit(kind)
    for kind in list(sums):
        yield emit(kind)


def _hashed(keys: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return arrays.mix(keys + np.asarray(kind, U) * U(arrays.BASE))


@dataclass
class Part:
    """A range of a model: sorted hashes, and per hash languages with what they add to the log-probability."""

    hashes: np.ndarray
    firsts: np.ndarray
    which: np.ndarray
    values: np.ndarray

    def sums(self, texts: list[str | None], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums by text and language, and the number of letters and spaces."""
        values, offsets = codes(texts)
        size = np.diff(offsets)
        sums = np.zeros((len(size), n_langs))
        if not len(values) or not len(self.hashes):
            return sums, size
        told = pa.array(grams(values, offsets)).dictionary_encode()
        keys, at = told.dictionary.to_numpy(), told.indices.to_numpy()
        rows = np.zeros((len(keys), n_langs))
        for order in range(1, ORDER + 1):
            near = keys & MASK[order]
            self._add(rows, _hashed(near, order))
            self._add(rows, _hashed(near >> U(16), order + CONTEXT))
        full = size > 0
        for lang, row in enumerate(np.ascontiguousarray(rows.T)):
            sums[full, lang] = np.add.reduceat(row[at], offsets[:-1][full])
        return sums, size

    def _add(self, rows: np.ndarray, code: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == code)
        at = at[found]
        count = self.firsts[at + 1] - self.firsts[at]
        place = np.arange(count.sum()) + np.repeat(self.firsts[at] - np.cumsum(count) + count, count)
        rows[np.repeat(found, count), self.which[place]] += self.values[place]


@dataclass
class Model:
    """The table of what n-grams and contexts add, the uniform guess, and the calibration."""

    langs: list[str]
    table: DataFrame | None = None
    parts: int = 1
    unknown: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None

    def part(self, number: int) -> Part:
        """One of ``parts`` equal ranges of hashes."""
        least, step = -(1 << 63), (1 << 64) // self.parts
        wanted = F.col("hash") >= least + number * step
        if number + 1 < self.parts:
            wanted &= F.col("hash") < least + (number + 1) * step
        found = self.table.where(wanted).select("hash", "which", "value").toArrow()
        hashes = found["hash"].to_numpy().view(U)
        rank = np.argsort(hashes, kind="stable")
        hashes, firsts = np.unique(hashes[rank], return_index=True)
        return Part(hashes, np.append(firsts, len(rank)), found["which"].to_numpy()[rank], found["value"].to_numpy()[rank])

    def entropies(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cross-entropy per character by text and language, from the sums of all parts."""
        return np.where(size > 0, -self.unknown, 0.0)[:, None] - sums / np.maximum(size, 1)[:, None]

    def predict(self, sums: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, chance of being right, and whether to reject."""
        if not self.langs:
            return ["und"] * len(size), np.zeros(len(size)), np.ones(len(size), bool)
        entropy = self.entropies(sums, size)
        best = entropy.argmin(1)
        chance = np.where(size > 0, 1 / (1 + np.exp(-np.clip(self.measures(entropy, size) @ self.curve, -30, 30))), 0.0)
        far = np.zeros(len(size), bool)
        if self.usual is not None:
            far = entropy[np.arange(len(best)), best] > self.usual[best] + self.spread[best] * (4 + 40 / np.sqrt(np.maximum(size, 1)))
        names = [self.langs[b] if n else "und" for b, n in zip(best.tolist(), size.tolist(), strict=True)]
        return names, chance, far | (chance < 0.5) | (size == 0)

    @staticmethod
    def measures(entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What the chance depends on: the lead per character and in all, and a constant."""
        two = np.sort(entropy, 1)[:, :2]
        lead = two[:, 1] - two[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
        return np.stack([np.log1p(lead * size), lead, np.ones(len(lead))], 1)


def build(langs: list[str], counts: DataFrame, kinds: int = 1) -> list[Model]:
    """Models from packed 4-grams ``key`` with their language's place ``which`` and count ``n``.

    ``kinds`` models over the same languages are built at once, their places following each other.
    """
    levels, width = {ORDER: counts.select("which", "key", "n")}, len(langs)
    kind = F.floor(F.col("which") / width).cast("int")
    for order in range(ORDER - 1, 0, -1):
        below = levels[order + 1].groupBy("which", F.col("key").bitwiseAND(F.lit(int(MASK[order]))).alias("key"))
        levels[order] = materialise(below.agg(F.count("*").alias("n")))
    rare = None
    for order, level in levels.items():
        some = level.where("n <= 2").select(F.lit(order).alias("order"), "which", "n")
        rare = some if rare is None else rare.union(some)
    discounts = np.full((ORDER + 1, kinds * width), 0.1)
    for order, which, once, twice in rare.groupBy("order", "which").agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).collect():
        discounts[order, which] = np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)
    sizes = dict(levels[1].select(kind.alias("kind"), "key").distinct().groupBy("kind").count().collect())
    guess = [1 / (sizes.get(k, 0) + 1) for k in range(kinds)]
    table, lower = None, None
    for order in range(1, ORDER + 1):
        discount = F.array(*[F.lit(float(d)) for d in discounts[order]])[F.col("which")]
        level = levels[order].withColumn("context", F.shiftrightunsigned("key", 16)).withColumn("below", F.col("key").bitwiseAND(F.lit(int(MASK[order - 1]))))
        around = level.groupBy("which", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        around = around.select("which", "context", "total", (discount * F.col("kinds") / F.col("total")).alias("weight"))
        level = level.join(around, ["which", "context"])
        if order == 1:
            level = level.withColumn("down", F.array(*map(F.lit, guess))[kind])
        else:
            level = level.join(lower.select("which", F.col("key").alias("below"), F.col("p").alias("down")), ["which", "below"])
        level = level.withColumn("p", (F.col("n") - discount) / F.col("total") + F.col("weight") * F.col("down"))
        lower = materialise(level.select("which", "key", "p", (F.log("p") - F.log("weight") - F.log("down")).alias("gain")))
        for code, key, value, rows in ((order, "key", F.col("gain"), lower), (order + CONTEXT, "context", F.log("weight"), around)):
            entries = rows.select(F.lit(code).alias("kind"), F.col(key).alias("key"), "which", value.cast("float").alias("value"))
            table = entries if table is None else table.union(entries)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _hashed(batch["key"].to_numpy().view(U), batch["kind"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch["which"], batch["value"]], ["hash", "which", "value"])

    table = materialise(table.mapInArrow(hashed, "hash long, which int, value float"))
    counted, models = dict(table.groupBy(kind.alias("kind")).count().collect()), []
    for k in range(kinds):
        parts = max(1, -(-counted.get(k, 0) // PART))
        mine = table.where(kind == k).withColumn("which", F.col("which") - k * width)
        if parts > 1:  # so that a range is read from its own files
            mine = materialise(mine.repartitionByRange(parts, "hash").sortWithinPartitions("hash"))
        models.append(Model(langs, mine, parts, float(np.log(guess[k]))))
    return models


def fold(id: Column) -> Column:
    """0 to 3; 2 is held out."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count on folds 0, 1 and 3, calibrate on documents of fold 1 before they are counted; fold 2 is never read."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    rows = rows.where(F.col("text").isNotNull()).withColumn("fold", fold(F.col("id"))).where("fold <> 2")
    order = F.xxhash64("id", F.lit(7)), F.col("id")
    chosen = materialise(rows.where("fold = 1").select("id").distinct().orderBy(*order).limit(SAMPLE))
    chosen = small_side(chosen)
    marked = rows.join(chosen.withColumn("held", F.lit(True)), "id", "left").select("lang", F.coalesce("held", F.lit(False)).alias("held"), "text")
    counts = marked.mapInArrow(_count, "lang string, held boolean, key long, n long").groupBy("lang", "key")
    counts = materialise(counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("rest")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([])
    places = docs.sparkSession.createDataFrame(list(enumerate(langs)), "which int, lang string")
    both = F.array(F.struct("which", "n"), F.struct((F.col("which") + len(langs)).alias("which"), F.col("rest").alias("n")))
    counts = counts.join(F.broadcast(places), "lang").select("key", F.explode(both).alias("x"))
    counts = materialise(counts.select("x.which", "key", "x.n").where("n > 0"))
    sample = rows.where("fold = 1").join(chosen, "id", "left_semi").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x"))
    sample = materialise(sample.select("x.lang", "x.text"))
    model, early = build(langs, counts, 2)

    def measured(part: pa.RecordBatch, sums: np.ndarray, size: np.ndarray) -> list[pa.Array]:
        return [part["lang"], pa.array(size), pa.array(list(sums), pa.list_(pa.float64()))]

    seen = _summed(sample, early, "text", measured, T.StructType.fromDDL("lang string, size long, sums array<double>")).where("size > 0").toPandas()
    seen = seen[seen["lang"].isin(langs)]
    if len(seen):
        size = seen["size"].to_numpy()
        _calibrate(model, np.searchsorted(np.array(langs), seen["lang"].to_numpy(str)), early.entropies(np.stack(seen["sums"].to_numpy()), size), size)
    return model


def _summed(docs: DataFrame, model: Model, text: str, finish: Callable, schema: T.StructType) -> DataFrame:
    """What ``finish`` makes of slices of rows with their sums by language and numbers of characters."""
    names, width, bytes_ = schema.names, len(model.langs), _slice(model)
    context = docs.sparkSession.sparkContext
    if model.parts == 1:
        none = Part(np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
        sent = context.broadcast(none if model.table is None else model.part(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in arrays.slices(batch, text, most_bytes=bytes_):
                    yield pa.RecordBatch.from_arrays(finish(part, *sent.value.sums(part[text].to_pylist(), width)), names)

        return docs.mapInArrow(run, schema)
    docs = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    sums = None
    for number in range(model.parts):
        sent = context.broadcast(model.part(number))

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in arrays.slices(batch, "text", most_bytes=bytes_):
                    found, size = sent.value.sums(part["text"].to_pylist(), width)
                    yield pa.RecordBatch.from_arrays([part["__row"], pa.array(size), pa.array(list(found), pa.list_(pa.float64()))], ["__row", "__size", "__sums"])

        some = materialise(docs.select("__row", F.col(f"`{text}`").alias("text")).mapInArrow(add, "__row long, __size long, __sums array<double>"))
        sent.destroy()
        sums = some if sums is None else sums.union(some)
    total = F.array(*[F.sum(F.col("__sums")[i]) for i in range(width)])
    sums = sums.groupBy("__row").agg(F.first("__size").alias("__size"), total.alias("__sums"))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["__sums"].flatten().to_numpy().reshape(-1, width)
            yield pa.RecordBatch.from_arrays(finish(batch, found, batch["__size"].to_numpy()), names)

    return docs.join(sums, "__row").mapInArrow(end, schema)


def _calibrate(model: Model, truth: np.ndarray, entropy: np.ndarray, size: np.ndarray) -> None:
    x, right = Model.measures(entropy, size), (entropy.argmin(1) == truth).astype(float)
    x, right = np.concatenate([x, [[0, 0, 1]] * 2]), np.append(right, [0.0, 1.0])  # without a lead it is a guess
    curve = np.zeros(3)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        curve -= np.linalg.solve((x.T * (s * (1 - s))) @ x + 0.01 * np.eye(3), x.T @ (s - right) + 0.01 * curve)
    model.curve = curve
    own = entropy[np.arange(len(truth)), truth]
    long = size >= np.median(size)
    every = own[long].mean(), own[long].std() + 1e-3
    parts = [own[long & (truth == i)] for i in range(len(model.langs))]
    model.usual = np.array([p.mean() if len(p) > 9 else every[0] for p in parts])
    model.spread = np.array([p.std() + 1e-3 if len(p) > 9 else every[1] for p in parts])


def _slice(model: Model) -> int:
    """Bytes of text at a time, so that a row of numbers per character stays small."""
    return max(1 << 15, (2 << 20) // max(1, len(model.langs)))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    kept = [c for c in docs.columns if c not in RESULTS]
    judge = replace(model, table=None)

    def finish(part: pa.RecordBatch, sums: np.ndarray, size: np.ndarray) -> list[pa.Array]:
        return [*[part[c] for c in kept], *map(pa.array, judge.predict(sums, size))]

    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    return _summed(plain, model, text, finish, arrays.with_fields(plain.schema, lang_pred="string", score="double", rejected="boolean"))
