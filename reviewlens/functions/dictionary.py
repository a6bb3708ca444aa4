"""Replacement by a long dictionary, entry after entry, at the cost of the entries that occur.

The result is that of :func:`reviewlens.functions.text.replace_substrings`: every key is replaced wherever it occurs, in the
order of the entries, and later entries see what earlier ones wrote. That fold passes over the text once per key. Here
one automaton over all keys passes once and says which of them occur; only these are applied. A key can appear later only where
a value was written, so after an entry has fired, just the later keys that share letters with its value are looked for.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def can_appear(key: str, value: str) -> bool:
    """Whether writing ``value`` somewhere can make an occurrence of ``key``: one that holds a letter of the value."""
    if key in value or value in key:
        return True
    most = min(len(key), len(value)) + 1
    return any(value.endswith(key[:n]) or value.startswith(key[-n:]) for n in range(1, most))


class Replacer:
    """The entries with a key and a value, ready to be applied to texts."""

    def __init__(self, pairs: Sequence[tuple[str, str]]):
        self.pairs = [(k, v) for k, v in pairs if k and v]
        self.places: dict[str, list[int]] = {}
        for i, (key, _) in enumerate(self.pairs):
            self.places.setdefault(key, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key in self.places:
            self.automaton.add_word(key, key)
        self.automaton.make_automaton()
        self.after: dict[int, list[int]] = {}

    def _later(self, i: int) -> list[int]:
        """Later entries whose key can appear where entry ``i`` writes its value; found when it first fires."""
        if i not in self.after:
            value = self.pairs[i][1]
            self.after[i] = [j for j in range(i + 1, len(self.pairs)) if can_appear(self.pairs[j][0], value)]
        return self.after[i]

    def __call__(self, text: str) -> str:
        if not self.pairs:
            return text
        waiting = {i for key in {found for _, found in self.automaton.iter(text)} for i in self.places[key]}
        order = list(waiting)
        heapq.heapify(order)
        while order:
            i = heapq.heappop(order)
            key, value = self.pairs[i]
            if key not in text:
                continue  # an earlier entry took it apart
            text = text.replace(key, value)
            for j in self._later(i):
                if j not in waiting and self.pairs[j][0] in text:
                    waiting.add(j)
                    heapq.heappush(order, j)
        return text


def replace_entries(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply ordered entries to a text column; entries with an empty key or value are left out, null stays null.

    The entries travel with the function: take them from :func:`reviewlens.operators.features.dictionary_pairs`, which bounds them.
    """
    replacer: list[Replacer] = []
    entries = list(pairs)

    @F.arrow_udf("string")
    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not replacer:
            replacer.append(Replacer(entries))
        for batch in batches:
            yield pa.array([None if t is None else replacer[0](t) for t in batch.to_pylist()], pa.string())

    return replaced(text)
