"""Words of whole Arrow text batches as NumPy arrays: segmentation and hashing without a Python loop per word.

White space is ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased, so bytes of other letters pass unchanged.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.isin(np.arange(256), SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
INVERSE = pow(BASE, -1, 2**64)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE))[LOWER]


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """A schema with fields of these names and types added."""
    return T.StructType([*schema.fields, *[T.StructType.fromDDL(f"`{n}` {k}").fields[0] for n, k in kinds.items()]])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column back to back, and where each text starts (one more than texts)."""
    filled = pc.fill_null(column, "").cast(pa.large_binary())
    _, ends, data = filled.buffers()
    offsets = np.frombuffer(ends, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if not len(filled) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most_rows: int = 1024, most_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text; a longer text is a slice of its own, never cut."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, len(sizes))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    starts = np.flatnonzero(inside & (~before[:-1] | border[:-1]))
    after = np.append(inside[1:], False)
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    powers = np.full(len(data), BASE, U)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * powers, out=sums[1:])
    back = np.full(len(data), INVERSE, U)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``k`` words; a text with 1 to ``k - 1`` words is one run."""
    count = np.diff(firsts)
    owner = np.repeat(np.arange(len(count)), count)
    full = np.flatnonzero(owner[: max(0, len(owner) - k + 1)] == owner[k - 1 :]) if len(owner) >= k else np.zeros(0, np.int64)
    value = np.full(len(full), k, U)
    for j in range(k):
        value = mix(value * U(BASE) + hashes[full + j])
    short = np.flatnonzero((count > 0) & (count < k))
    rest = count[short].astype(U)
    for j in range(k - 1):
        more = count[short] > j
        at = np.where(more, firsts[short] + j, 0)
        rest = np.where(more, mix(rest * U(BASE) + hashes[at]), rest) if len(hashes) else rest
    return np.concatenate([value, rest]), np.concatenate([owner[full], short])
