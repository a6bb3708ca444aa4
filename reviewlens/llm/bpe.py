"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The texts of a slice become words (matches of the split pattern); each distinct word not met before in the
task joins a batch. An inverted index from merge rank, and so from token pairs, to word positions holds
where a pair occurs in the whole batch. Merges are applied in rank order, each at all its positions at once;
only the touched neighbours get new entries. Words met before come from the task's lexicon, which is emptied
when it holds more than ``MOST_WORDS``. Nothing is shuffled.

Cases: null and empty texts have no ids; ids decode to the bytes of the text; an unknown id fails the job
with its number; other columns and repeated or null document ids pass unchanged. Very long texts and words
are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays

NONE = np.iinfo(np.int64).max
MOST_WORDS = 200_000
SLICE_BYTES = 2 << 20
DECODED = 1 << 16


def load_ranks(path: str) -> bytes:
    """The rank file's content. Read on the driver and sent along: executors need no copy of the file."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Tokens by rank, and the rank that each mergeable pair of tokens has."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        size = max(ranks.values()) + 1
        self.ranks = ranks
        self.lengths = np.full(size, -1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.data = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.starts = np.zeros(size, np.int64)
        known = self.lengths >= 0
        self.starts[known] = np.concatenate([[0], np.cumsum(self.lengths[known])[:-1]])
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[token[:i]] << 32 | ranks[token[i:]], rank)
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        ]
        pairs.sort()
        self.keys, self.merged = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it does not merge; a side of -1 is the end of a word."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.merged[at], NONE)

    def plain(self, word: bytes) -> list[int]:
        """One word alone: lowest rank first, leftmost first."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NONE))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        wrong = ids[(ids < 0) | (ids >= len(self.lengths))] if len(ids) else ids
        if len(wrong) or (self.lengths[ids] < 0).any():
            raise ValueError(f"no token has the id {wrong[0] if len(wrong) else ids[self.lengths[ids] < 0][0]}")
        return gather(self.data, self.starts[ids], self.lengths[ids])

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of the texts whose ids lie between these ends, about ``DECODED`` ids at a time."""
        out, at = [], 0
        while at < len(ends) - 1:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED, "right")) - 1)
            run = ids[ends[at] : ends[to]]
            data = self.decode(run).tobytes()
            cuts = np.concatenate([[0], np.cumsum(self.lengths[run])])[ends[at : to + 1] - ends[at]].tolist()
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = to
        return out


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, back to back."""
    before = np.cumsum(lengths) - lengths
    return values[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words back to back, and their number per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    word = np.repeat(np.arange(len(words)), lengths)
    symbol = np.append(vocab.single[data], -1)
    following, previous = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(lengths)
    following[ends[lengths > 0] - 1] = n
    previous[(ends - lengths)[lengths > 0]] = -1
    rank = np.append(vocab.merges(symbol[:-1], symbol[following[:-1]]), NONE)
    odd = np.zeros(len(words), bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(at: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    at = np.flatnonzero(rank != NONE)
    if len(at):
        file(at, rank[at])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            at = np.unique(at)
            chained = following[at[:-1]] == at[1:]
            if chained.any():  # as in a run of one letter: every other place, from the left
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), place, 0))
                at = at[(place - begin) % 2 == 0]
        gone = following[at]
        after = following[gone]
        symbol[at], symbol[gone], rank[gone] = r, -1, NONE
        following[at], previous[after] = after, at
        left = previous[at]
        touched = np.concatenate([at, left[left >= 0]])
        now = vocab.merges(symbol[touched], symbol[following[touched]])
        rank[touched] = now
        if (now < r).any():  # this word's merges no longer come in rank order
            odd[word[touched[now < r]]] = True
        open_ = now != NONE
        if open_.any():
            file(touched[open_], now[open_])
    kept = symbol[:-1] >= 0
    ids, counts = symbol[:-1][kept], np.bincount(word[kept], minlength=len(words))
    if odd.any():
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(vocab.plain(words[i]), np.int64)
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
    return ids, counts


class Lexicon:
    """Ids of the words a task has met, which are numbered as they come."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Replay the merges over the words that were numbered since the last time."""
        new = list(islice(self.place, len(self.counts), None))
        if not new:
            return
        ids, counts = replay([w.encode() for w in new], self.vocab)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.ids = np.append(self.ids, ids.astype(np.int32))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = (), decoded: str | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with the token ids of each text, without special tokens.

    ``decoded`` names a column for the bytes that the ids decode to, taken in the same pass: a pass of its own would need a
    second worker per task.
    """
    kept = list(keep) or [c for c in docs.columns if c not in (ids, decoded)]
    place = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, lexicon = regex.compile(pattern).findall, Lexicon(vocabulary(ranks))
        for batch in batches:
            for part in arrays.slices(batch, "__text", most_rows=4096, most_bytes=SLICE_BYTES):
                if len(lexicon.place) > MOST_WORDS:
                    lexicon.clear()
                # Of a text's words only the numbers are held.
                found = [np.fromiter(map(lexicon.place.__getitem__, split(t)), np.int32) for t in part["__text"].to_pylist()]
                lexicon.learn()
                counts = np.fromiter(map(len, found), np.int64, len(found))
                where = np.concatenate(found)
                sizes = lexicon.counts[where]
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                tokens = gather(lexicon.ids, lexicon.starts[where], sizes)
                out = _with(part.select(kept), ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens)))
                if decoded is not None:
                    out = _with(out, decoded, pa.array(lexicon.vocab.texts(tokens, ends), pa.binary()))
                yield out

    more = {ids: "array<int>"} | ({} if decoded is None else {decoded: "binary"})
    return place.mapInArrow(run, arrays.with_fields(place.drop("__text").schema, **more))


def decode(docs: DataFrame, ranks: bytes, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for batch in batches:
            values = [vocab.decode(x.values.to_numpy().astype(np.int64)).tobytes() if x.is_valid else b"" for x in batch[ids]]
            yield _with(batch, decoded, pa.array(values, pa.binary()))

    return docs.mapInArrow(run, arrays.with_fields(docs.schema, **{decoded: "binary"}))
