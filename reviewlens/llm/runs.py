"""Periodic runs of words by recursive frequency splitting.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical),
at least ``LEAST_LENGTH`` words and at least ``LEAST_TIMES`` periods long, that no neighbouring word extends. Such a run
holds each of its words ``LEAST_TIMES`` times, so a word that is rarer than that in a segment of the text is in no run
inside it: it splits the segment, and the parts are counted anew until nothing changes. All segments of a slice of
texts are counted at once.

The lag scan of the surviving segments goes by powers of two. In a run of smallest period ``q``, a passage of ``s >= q``
words occurs again after exactly ``q`` words, never earlier. So for ``s / 2 < q <= s`` the runs are the stretches of
places whose passage of ``s`` words next occurs ``q`` words on: a sort per power of two instead of a comparison per lag.

Cases: a null or empty text, or one without words, has no runs and an empty collapsed text; equal texts have equal
results; texts are taken whole, and memory follows the longest one (about 15 bytes a byte of text); columns of the
input stay, one that is named like an added column is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays

LEAST_LENGTH = 6
LEAST_TIMES = 4
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def surviving(word: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments without rare words; ``owner`` numbers the text of each word, in order."""
    at, segment = np.arange(len(word)), owner
    width = int(word.max(initial=0)) + 1
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(segment) != 0)) + 1
        first, after = np.append(0, cut), np.append(cut, len(at))
        segment = np.repeat(np.arange(len(first)), after - first)
        _, place, times = np.unique(segment * width + word[at], return_inverse=True, return_counts=True)
        rare = times[place] < LEAST_TIMES
        long = after - first >= LEAST_LENGTH
        stable = long & (np.bincount(segment, rare, len(first)) == 0)
        starts.append(at[first[stable]])
        ends.append(at[after[stable] - 1] + 1)
        again = (long & ~stable)[segment] & ~rare
        at, segment = at[again], segment[again]
    return np.concatenate(starts), np.concatenate(ends)


def lag_scan(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows ``(start, length, period)`` of the runs inside these segments, by start, then period."""
    size = ends - starts
    if not len(size):
        return np.zeros((0, 3), np.int64)
    # The segments back to back, each followed by a word that occurs nowhere else.
    offset = np.cumsum(size + 1) - size - 1
    place = np.arange(int((size + 1).sum())) + np.repeat(starts - offset, size + 1)
    border = offset + size
    passage = word[np.minimum(place, len(word) - 1)].astype(np.int64)
    passage[border] = int(word.max()) + 1 + np.arange(len(border))
    found, s = [np.zeros((0, 3), np.int64)], 1
    while True:
        order = np.argsort(passage, kind="stable")
        same = passage[order[1:]] == passage[order[:-1]]
        lag = np.zeros(len(passage), np.int64)
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        lag[(lag <= s // 2) | (lag > s)] = 0
        cut = np.flatnonzero(np.diff(lag)) + 1
        first, after = np.append(0, cut), np.append(cut, len(lag))
        period = lag[first]
        length = after - first - 1 + period + s
        keep = (period > 0) & (length >= np.maximum(LEAST_LENGTH, LEAST_TIMES * period))
        found.append(np.stack([place[first[keep]], length[keep], period[keep]], 1))
        if LEAST_TIMES * (s + 1) > size.max():
            break
        # Passages of twice the length are pairs of passages.
        pair = passage[:-s] * (int(passage.max()) + 1) + passage[s:]
        passage = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        s *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of these texts' words, back to back, and where those of each text start (one more than texts)."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    offsets = np.append(0, np.cumsum(sizes))
    runs = lag_scan(word, *surviving(word, np.repeat(np.arange(len(texts)), sizes)))
    bounds = np.searchsorted(runs[:, 0], offsets)
    runs[:, 0] -= np.repeat(offsets[:-1], np.diff(bounds))
    return runs, bounds


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, *, text: str = "text", runs: str = "runs", short: str = "collapsed") -> DataFrame:
    """The documents with ``runs`` (start, length and period in words, by start, then period) and the text ``short``
    in which one period of every run is left."""
    if text in (runs, short):
        raise ValueError(f"the text column can't be named like the added column {text!r}")
    kept = docs.drop(runs, short)
    schema = arrays.with_fields(kept.schema, **{runs: RUN, short: "string"})
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text):
                # bytes.split() splits at exactly the white space above.
                words = [t.split() for t in pc.fill_null(part[text], "").cast(pa.large_binary()).to_pylist()]
                found, bounds = runs_of(words)
                listed = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], fields=list(fields))
                shorter = [collapsed(w, found[a:b]) for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed), pa.array(shorter, pa.binary()).cast(pa.string())],
                    [*part.schema.names, runs, short],
                )

    return kept.mapInArrow(scan, schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length; ties go to the smallest start, then period. Null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["order"]).alias("length"), best["period"].alias("period")))
