"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of ``e`` is cut into ``e + 1`` pieces: whatever ``e`` edits did, one piece is
intact. Rolling hashes of every window of a text are looked up among the hashes of the pieces' first bytes;
around each hit Myers' bit-parallel algorithm decides whether the whole item occurs within its budget.

Texts and items are compared as UTF-8 with A-Z lower-cased and runs of white space as one space, so that line
breaks and case don't hide a match. The budget is ``rate`` times the item's bytes, less where pieces would
be shorter than 8 bytes. Items below ``least_bytes`` are too common to tell anything and match nothing.

Cases: null or empty texts and items match nothing; copies of an item all match, each under its own id; items
without an id are ignored; every row of ``docs`` is kept with all its columns (one of the result's name is
replaced). Items travel to the tasks in slices of at most ``SLICE_BYTES``, one pass over the texts each, so a
benchmark of any size works. Long texts are searched whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays

U = np.uint64
SEEDS = (16, 11, 8)
SLICE_BYTES = 4 << 20
MATCHES = "array<struct<item_id:bigint,errors:int>>"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with single spaces between words, and where each starts."""
    if not len(data):
        return data, offsets
    space = arrays.IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:-1]
    keep[0] = not space[0]
    kept = np.where(space, np.uint8(32), arrays.LOWER[data])[keep]
    return kept, np.concatenate([[0], np.cumsum(keep)])[offsets]


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes."""
    if len(data) < size:
        return np.zeros(0, U)
    value = arrays.BYTE_VALUES[data]
    power, length = arrays.BASE, 1
    whole, done, at = None, 0, value
    # Runs of 1, 2, 4, ... bytes; those that the size is made of are put together.
    while length <= size:
        if size & length:
            n = len(data) - (done + length) + 1
            whole = at[:n] if whole is None else at[done : done + n] + whole[:n] * U(power)
            done += length
        if 2 * length <= size:
            at = at[length:] + at[:-length] * U(power)
        power, length = power * power % 2**64, 2 * length
    return arrays.mix(whole)


def distance(item: bytes, text: bytes, most: int) -> int | None:
    """The least number of edits that make ``item`` a part of ``text``, or None beyond ``most`` (Myers 1999)."""
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, b in enumerate(item):
        masks[b] |= 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, m
    for b in text:
        eq = masks.get(b, 0)
        vertical = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best if best <= most else None


def budget(length: int, rate: float) -> int:
    """Errors allowed in an item of so many bytes."""
    return max(0, min(int(rate * length), length // SEEDS[-1] - 1))


class Pieces:
    """Items and the hashes of their pieces' first bytes, by seed length."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_bytes: int):
        self.items: list[tuple[int, bytes, int]] = []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for name, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            plain, _ = normalised(raw, np.array([0, len(raw)]))
            body = plain.tobytes().rstrip(b" ")
            if len(body) < max(least_bytes, SEEDS[-1]):
                continue
            errors = budget(len(body), rate)
            step = len(body) // (errors + 1)
            seed = next(s for s in SEEDS if s <= step)
            plain = plain[: len(body)]
            hashes = windows(plain, seed)
            for start in range(0, step * (errors + 1), step):
                found[seed].append((int(hashes[start]), len(self.items), start))
            self.items.append((name, body, errors))
        self.seeds = {}
        for seed, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], U)
            bits = np.zeros(1 << 20, bool)
            bits[(keys >> U(44)).astype(np.int64)] = True
            self.seeds[seed] = keys, bits, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """By text and item the places where the item would begin."""
        out: dict[tuple[int, int], list[int]] = defaultdict(list)
        for seed, (keys, bits, item, start) in self.seeds.items():
            value = windows(data, seed)
            at = np.flatnonzero(bits[(value >> U(44)).astype(np.int64)])
            low, high = np.searchsorted(keys, value[at], "left"), np.searchsorted(keys, value[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            owner = np.searchsorted(offsets, at, "right") - 1
            inside = at + seed <= offsets[owner + 1]
            for p, o, a, b in zip(at[inside].tolist(), owner[inside].tolist(), low[inside].tolist(), high[inside].tolist(), strict=True):
                for j in range(a, b):
                    out[o, int(item[j])].append(p - int(start[j]))
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per text the items found, each with its least number of errors."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (owner, i), places in sorted(self.hits(data, offsets).items()):
            name, body, errors = self.items[i]
            spans: list[list[int]] = []
            for p in sorted(set(places)):
                low, high = max(p - errors, offsets[owner]), min(p + len(body) + errors, offsets[owner + 1])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            found = [d for low, high in spans if (d := distance(body, data[low:high].tobytes(), errors)) is not None]
            if found:
                out[owner].append((name, min(found)))
        return out


def benchmark_matches(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = 0.08, least_bytes: int = 24, name: str = "matches",
) -> DataFrame:
    """``docs`` with the column ``name``: the items that occur in the text, with their numbers of errors."""
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = listed.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = int(total // SLICE_BYTES) + 1
    kept = [c for c in docs.columns if c != name]
    result = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(name, F.array().cast(MATCHES))
    for n in range(count):
        mine = [(r["i"], r["t"]) for r in listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == n).orderBy("i", "t").collect()]
        result = _search(result, mine, text, name, rate, least_bytes)
    return result


def _search(docs: DataFrame, items: list[tuple[int, str]], text: str, name: str, rate: float, least_bytes: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("errors", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value, rate, least_bytes)
        for batch in batches:
            for part in arrays.slices(batch, text):
                found = pieces.matches(*normalised(*arrays.utf8(part[text])))
                before = part[name].to_pylist()
                rows = [(b or []) + [{"item_id": n, "errors": e} for n, e in found.get(i, [])] for i, b in enumerate(before)]
                names = part.schema.names
                yield pa.RecordBatch.from_arrays([pa.array(rows, kind) if c == name else part[c] for c in names], names)

    return docs.mapInArrow(run, docs.schema)
