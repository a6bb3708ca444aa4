"""Fingerprints of texts that can be moved and added: the mark of a long text is the sum of its parts' marks.

A mark holds, for each of four primes, the value of the polynomial with the text's bytes as coefficients, the first byte constant. A text
that begins ``n`` bytes further on has its mark times the base to the power ``n``. So texts that are joined only in thought are
compared by numbers, 124 bits together, and no text is moved.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Primes and bases; products of two residues fit into 64 bits.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_029), (2_147_483_587, 1_812_433_253), (2_147_483_579, 1_566_083_941))
# Bytes that are multiplied at a time.
CHUNK = 1 << 18


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """The powers 0 to ``count - 1`` of a base, by doubling."""
    found = np.ones(1, np.int64)
    while len(found) < count:
        found = np.concatenate([found, found * pow(base, len(found), prime) % prime])
    return found[:count]


class Marker:
    """Marks of whole Arrow arrays of texts."""

    def __init__(self) -> None:
        self.tables = [powers(base, prime, CHUNK) for prime, base in MODULI]

    def _runs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Marks of runs of at most ``CHUNK`` bytes that follow each other."""
        first = int(starts[0])
        place = np.arange(int(sizes.sum())) - np.repeat(starts - first, sizes)
        value = data[first : first + len(place)].astype(np.int64) + 1
        full, out = np.flatnonzero(sizes), np.zeros((len(sizes), len(MODULI)), np.int64)
        for i, (prime, _) in enumerate(MODULI):
            if len(full):
                out[full, i] = np.add.reduceat(value * self.tables[i][place] % prime, (starts - first)[full]) % prime
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """One row of marks per text; a null text counts as empty."""
        filled = pc.fill_null(texts, "").cast(pa.large_binary())
        _, ends, buffer = filled.buffers()
        offsets = np.frombuffer(ends, np.int64)[filled.offset : filled.offset + len(filled) + 1]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        out, at = np.zeros((len(filled), len(MODULI)), np.int64), 0
        while at < len(filled):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            if offsets[at + 1] - offsets[at] <= CHUNK:
                out[at:to] = self._runs(data, offsets[at:to], np.diff(offsets[at : to + 1]))
            else:  # a long text by chunks
                to = at + 1
                cuts = np.append(np.arange(offsets[at], offsets[at + 1], CHUNK), offsets[at + 1])
                for start, size in zip(cuts[:-1], np.diff(cuts), strict=True):
                    part = self._runs(data, np.array([start]), np.array([size]))[0]
                    out[at] = [(whole + moved(int(p), int(start - offsets[at]), i)) % MODULI[i][0] for i, (whole, p) in enumerate(zip(out[at].tolist(), part, strict=True))]
            at = to
        return out


def moved(mark: int, places: int, i: int) -> int:
    """A part of a mark, for a text that begins ``places`` bytes further on."""
    prime, base = MODULI[i]
    return mark * pow(base, places, prime) % prime


def _listed(marks: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(marks.ravel()), len(MODULI)).cast(pa.list_(pa.int64()))


def text_marks(text: Column) -> Column:
    """The marks of a text column."""
    made: list[Marker] = []

    @F.arrow_udf("array<bigint>")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(Marker())
        for batch in batches:
            yield _listed(made[0](batch))

    return marked(text)


def moved_marks(marks: Column, places: Column) -> Column:
    """Marks for texts that begin so many bytes further on."""

    @F.arrow_udf("array<bigint>")
    def shifted(marks: pa.Array, places: pa.Array) -> pa.Array:
        rows = marks.flatten().to_numpy(zero_copy_only=False).reshape(len(marks), len(MODULI)).tolist()
        return _listed(np.array([[moved(m, n, i) for i, m in enumerate(row)] for row, n in zip(rows, places.to_pylist(), strict=True)], np.int64).reshape(-1, len(MODULI)))

    return shifted(marks, places)
