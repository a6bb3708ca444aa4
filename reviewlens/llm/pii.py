"""Personal data by patterns, and by bootstrapped contextual extraction.

The patterns give base spans (email, ip, card, phone): the seeds. The one and the two words before a seed are
lexical patterns, and tokens with an ``@`` inside or four digits and more that are no base span are candidates. Words are
what lies between white space and the marks of ``DELIMITERS``, so ``{"ssn":"5550109999"}`` and ``ssn = 5550109999`` are the same
context; they are cut and counted by one rule. Patterns and instances (the tokens) are a graph that Spark scores in
rounds: a pattern's confidence is the share of its occurrences in all texts that stand before a trusted instance, and it is
confident if that reaches ``threshold`` with ``LEAST`` different ones. Candidates behind a confident pattern are trusted in the
next round, and patterns that stand before these may become confident in turn. The rounds end when nothing more is
trusted; then candidates behind a confident pattern are spans of the kind ``other``.

Texts are read twice, for spans and to count the patterns' occurrences; what is shuffled are candidates and
counts, aggregated per task. A bitmap of fixed size (2**22 bits) keeps words out of the counts that precede fewer than ``LEAST``
different seeds and candidates, as these can never be confident.

Cases: null texts are empty and have no spans; without seeds nothing is added; a row with a repeated or null id is
a row of its own; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays
from reviewlens.llm.langid import tally
from reviewlens.llm.spans import SPANS
from reviewlens.plans.sizing import materialise

U = np.uint64
KINDS = ("email", "ip", "card", "phone", "other")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: what fails at its first digit fails at the others.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DELIMITERS = ",;()<>\"'{}[]:=|"
_INSIDE = r"[^\x20\x09-\x0D" + re.escape(DELIMITERS) + "]*"
TOKEN = re.compile(f"{_INSIDE}[0-9@]{_INSIDE}")
DIGITS, LEAST, MAP_BITS, HELD = 4, 3, 22, 1_000_000
# Bytes as contexts see them: delimiters separate words as white space does.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[ord(c) for c in DELIMITERS]] = 0x20


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost spans of each kind that do not overlap, failing matches dropped."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def _candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out = []
    for m in TOKEN.finditer(text) if "@" in text or any(d in text for d in "0123456789") else ():
        s, e = m.span()
        if ("@" in m[0][1:-1] or sum(c.isdigit() for c in m[0]) >= DIGITS) and all(e <= a or b <= s for _, a, b in base):
            out.append((s, e))
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each starts, and of all words the ends, hashes and number before each text."""
    data, offsets = arrays.utf8(texts)
    _, ends, hashes, firsts = arrays.words(PLAIN[data], offsets)
    return data, offsets, ends, hashes, firsts


def _contexts(texts: pa.Array, places: list[list[tuple[int, int, bool]]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the last word and of the last two words before each place; 0 where there are fewer."""
    data, offsets, ends, hashes, firsts = _words(texts)
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a code point
    before = np.searchsorted(letters, offsets)
    owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = letters[before[owner] + np.array([s for p in places for s, _, _ in p], np.int64)] if len(owner) else np.zeros(0, np.int64)
    last = np.searchsorted(ends, at, "right") - 1
    first = firsts[owner]
    one = np.where(last >= first, pattern_one(hashes[np.maximum(last, 0)]), U(0)) if len(hashes) else np.zeros(len(owner), U)
    two = np.where(last > first, pattern_two(hashes[np.maximum(last - 1, 0)], hashes[np.maximum(last, 0)]), U(0)) if len(hashes) else one
    return one, two


def pattern_one(word: np.ndarray) -> np.ndarray:
    return arrays.mix(word + U(1))


def pattern_two(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return arrays.mix(before * U(arrays.BASE) + word)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, and all seeds and candidates with their patterns and a hash of what they say."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    node = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("said", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            spans, places, said = [], [], []
            for text in part["text"].to_pylist():
                base = base_spans(text) if text else []
                found = [(s, e, True) for _, s, e in base] + [(s, e, False) for s, e in _candidates(text, base)] if text else []
                spans.append([{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base])
                places.append(found)
                said += ["".join(text[s:e].lower().split()) for s, e, _ in found]
            some = [i for i, found in enumerate(places) if found]
            one, two = _contexts(part["text"].take(pa.array(some, pa.int32())), [places[i] for i in some])
            data, offsets = arrays.utf8(pa.array(said, pa.string()))
            starts, _, hashes, firsts = arrays.words(data, offsets)
            values = hashes[np.minimum(firsts[:-1], max(0, len(hashes) - 1))].view(np.int64) if len(hashes) else np.zeros(0, np.int64)
            rows, i = [], 0
            for found in places:
                row = []
                for s, e, base in found:
                    patterns = sorted({int(x) for x in (one[i].view(np.int64), two[i].view(np.int64)) if x})
                    row.append({"start": s, "end": e, "base": base, "said": int(values[i]), "patterns": patterns})
                    i += 1
                rows.append(row)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(spans, span), pa.array(rows, node)], ["id", "spans", "nodes"])


def _occurrences(bitmap: np.ndarray):
    """How often each pattern that the bitmap knows stands before anything, summed within the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            keys, counts = tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["pattern", "n"])

        for batch in batches:
            for part in arrays.slices(batch, "text"):
                _, _, _, hashes, firsts = _words(part["text"])
                inner = np.ones(max(0, len(hashes) - 1), bool)
                inner[firsts[(firsts > 0) & (firsts < len(hashes))] - 1] = False
                keys = np.concatenate([pattern_one(hashes), pattern_two(hashes[:-1], hashes[1:])[inner]])
                held.append(tally(keys[bitmap[(keys >> U(64 - MAP_BITS)).astype(np.int64)]]))
            if sum(len(k) for k, _ in held) > HELD:
                yield emit()
        if held:
            yield emit()

    return count


def find_personal(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Per row of ``docs``: ``id`` and ``spans``."""
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = "array<struct<start:int,end:int,base:boolean,said:bigint,patterns:array<bigint>>>"
    read = texts.mapInArrow(_read, arrays.with_fields(texts.select("id").schema, spans=SPANS, nodes=kind))
    read = materialise(read.withColumn("row", F.monotonically_increasing_id()))
    nodes = materialise(read.select("row", F.explode("nodes").alias("x")).select("row", "x.start", "x.end", "x.base", "x.said", F.explode("x.patterns").alias("pattern")))
    accepted = _score(texts, nodes, threshold)
    result = read.select("row", "id", "spans")
    if accepted is not None:
        span = F.struct(F.lit("other").alias("kind"), "start", "end", F.lit(False).alias("base"))
        more = accepted.groupBy("row").agg(F.collect_set(span).alias("more"))
        result = result.join(more, "row", "left").withColumn("spans", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")))
    return result.select(F.col("id").alias(id), "spans")


def _score(texts: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame | None:
    """Occurrences of candidates behind confident patterns; none if there is no candidate or no seed."""
    if nodes.where("base").isEmpty() or nodes.where("NOT base").isEmpty():
        return None
    edges = materialise(nodes.groupBy("pattern", "said").agg(F.max("base").alias("base"), F.count("*").alias("n")))
    # A pattern of fewer instances can never be confident.
    met = materialise(edges.groupBy("pattern").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= LEAST).select("pattern"))
    bitmap = np.zeros(1 << MAP_BITS, bool)
    # At most as many buckets as the bitmap has bits.
    bitmap[met.select(F.shiftrightunsigned("pattern", 64 - MAP_BITS).alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    total = texts.select("text").mapInArrow(_occurrences(bitmap), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    edges = materialise(edges.join(total.join(met, "pattern", "left_semi"), "pattern"))
    trusted, before, confident = materialise(edges.where("base").select("said").distinct()), 0, met.limit(0)
    while True:
        count = trusted.count()
        if count == before:
            return nodes.where("NOT base").join(confident, "pattern", "left_semi")
        confident = edges.join(trusted, "said", "left_semi").groupBy("pattern", "total").agg(F.sum("n").alias("hits"), F.count("*").alias("kinds"))
        confident = materialise(confident.where((F.col("kinds") >= LEAST) & (F.col("hits") >= threshold * F.col("total"))).select("pattern"))
        found = edges.where("NOT base").join(confident, "pattern", "left_semi").select("said")
        trusted, before = materialise(trusted.union(found).distinct()), count
