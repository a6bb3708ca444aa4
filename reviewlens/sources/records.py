"""Delimited files with line breaks inside quotes, read by many tasks per file.

A line of such a file may begin inside a quoted field, which only the lines before it can tell. What a line does to that
state is a function of two values: the state it ends in when it begins outside quotes, and when it begins inside. These
functions compose, so a first pass reduces every split of a file to one of them, a window over the splits gives each
its state and line number, and a second pass cuts records where they lie. Only records that cross the border of a
split are shuffled, as fragments.

Records that can't be read are kept in a table of their own with file, line and reason. A quote opens a field at its start
only; elsewhere in an unquoted field it is a character. Doubled quotes inside quotes are one quote. Empty lines between
records are skipped; ``\\r`` at the end of a record belongs to its line break.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reviewlens.plans.sizing import materialise

# Sent to the workers with the functions themselves, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a record that is put together, and of the fragments it comes in.
RECORD_BYTES = 64 * 1024 * 1024
FRAGMENT_BYTES = 4 * 1024 * 1024

NOT_CLOSED = "quote not closed"
TOO_LONG = "record too long"
FIELDS = "number of fields"

_QUOTED = re.compile('[^"]*(?:""[^"]*)*')
_CORRUPT = "__corrupt"


class Records(NamedTuple):
    """Rows of the wanted columns, and ``(file, line, reason, record)`` of the records that have none."""

    rows: DataFrame
    malformed: DataFrame


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the text after this line is inside a quoted field, given whether the line begins inside one."""
    at = 0
    while True:
        if inside:
            at = _QUOTED.match(line, at).end()
            if at == len(line):
                return True
            at = line.find(delimiter, at + 1)  # behind the closing quote
            if at < 0:
                return False
            at += 1
        if not line.startswith('"', at):
            at = line.find(delimiter + '"', at)
            if at < 0:
                return False
            at += 1
        at, inside = at + 1, True


def _effects(lines: pa.Array, delimiter: str) -> tuple[np.ndarray, np.ndarray]:
    """For every line the state it ends in, when begun outside and when begun inside quotes."""
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
        line = lines[int(i)].as_py()
        outside[i], inside[i] = ends_inside(line, False, delimiter), ends_inside(line, True, delimiter)
    return outside, inside


def states_before(outside: np.ndarray, inside: np.ndarray, first: bool) -> np.ndarray:
    """The state ahead of each line, and after the last one, when the first line begins in state ``first``."""
    constant = outside == inside
    flips = np.append(0, np.cumsum(~constant & outside))
    place = np.maximum.accumulate(np.where(np.append(True, constant), np.arange(len(outside) + 1), 0))
    value = np.append(first, outside)[place]
    return value ^ ((flips - flips[place]) % 2 == 1)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one split."""
    file, block = batch["file"].dictionary_encode().indices.to_numpy(), batch["block"].to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _key(part: pa.RecordBatch) -> tuple[str, int]:
    return part["file"][0].as_py(), part["block"][0].as_py()


def _reduced(delimiter: str):
    """One row per split: its function and its number of lines."""
    names = ["file", "block", "outside", "inside", "lines"]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, lines = None, (False, True), 0
        for part in (p for batch in batches for p in _parts(batch)):
            if key not in (None, _key(part)):
                yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *state, lines), strict=True))])
                state, lines = (False, True), 0
            key = _key(part)
            effects = _effects(part["value"], delimiter)
            state = tuple(bool(states_before(*effects, s)[-1]) for s in state)
            lines += part.num_rows
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *state, lines), strict=True))])

    return reduced


_PIECE = pa.schema([("file", pa.string()), ("line", pa.int64()), ("record", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_())])


def _cut(delimiter: str):
    """Records inside a split, and fragments of those that cross its borders or are long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, number = None, False, 0
        # An open record: its lines, its bytes, its first line and whether that begins the record.
        held, size, start, opens = [], 0, 0, False

        def piece(closes: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "line": start, "record": "\n".join(held), "opens": opens, "closes": closes}], _PIECE)

        for part in (p for batch in batches for p in _parts(batch)):
            if key != _key(part):
                if held:
                    yield piece(False)
                key, state, number = _key(part), part["state"][0].as_py(), part["before"][0].as_py()
                held, size, start, opens = [], 0, number, False
            lines = part["value"]
            states = states_before(*_effects(lines, delimiter), state)
            whole = np.flatnonzero(~states[:-1] & ~states[1:])
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]] * len(whole)), pa.array(number + whole), lines.take(pa.array(whole)),
                pa.array(np.ones(len(whole), bool)), pa.array(np.ones(len(whole), bool)),
            ], schema=_PIECE)
            for i in np.flatnonzero(states[:-1] | states[1:]):
                if not states[i]:
                    start, opens = number + int(i), True
                line = lines[int(i)].as_py()
                held.append(line)
                size += len(line) + 1
                if not states[i + 1] or size > FRAGMENT_BYTES:
                    yield piece(not states[i + 1])
                    held, size, start, opens = [], 0, number + int(i) + 1, False
            state, number = bool(states[-1]), number + part.num_rows
        if held:
            yield piece(False)

    return cut


def cut_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(file, line, record, reason)``: the records' texts with the line they begin in; ``reason`` is null if they are whole."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kind = "file string, block long, outside boolean, inside boolean, lines long"
    splits = materialise(lines.mapInArrow(_reduced(delimiter), kind))
    # One row per split, so a file of 1 TB makes some thousand rows here.
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    constant = F.col("outside") == F.col("inside")
    flipped = splits.withColumn("flips", F.sum(F.when(~constant & F.col("outside"), 1).otherwise(0)).over(W.partitionBy("file").orderBy("block")))
    set_to = F.last(F.when(constant, F.struct("outside", "flips")), ignorenulls=True).over(before)
    ahead = F.coalesce(F.max("flips").over(before), F.lit(0))
    placed = flipped.select(
        "file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"), set_to.alias("last"), ahead.alias("ahead"))
    odd = (F.col("ahead") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1
    placed = placed.select("file", "block", "before", (F.coalesce(F.col("last.outside"), F.lit(False)) != odd).alias("state"))
    # Broadcast whatever its size, as the lines must keep their order: about 100 bytes a split of 128 MB.
    read = lines.join(F.broadcast(placed), ["file", "block"]).select("value", "file", "block", "state", "before")
    pieces = materialise(read.mapInArrow(_cut(delimiter), "file string, line long, record string, opens boolean, closes boolean"))
    whole = pieces.where("opens AND closes").select("file", "line", "record", F.lit(None).cast("string").alias("reason"))
    # Fragments: a few per split. The record of each is the last one opened.
    fragments = pieces.where("NOT (opens AND closes)")
    opened = F.last(F.when(F.col("opens"), F.col("line")), ignorenulls=True).over(W.partitionBy("file").orderBy("line"))
    owners = fragments.select("file", "line", F.octet_length("record").cast("long").alias("size"), "closes", opened.alias("first"))
    sizes = owners.groupBy("file", "first").agg(F.sum("size").alias("size"), F.max("closes").alias("closed"))
    reason = F.when(~F.col("closed"), NOT_CLOSED).when(F.col("size") > RECORD_BYTES, TOO_LONG)
    owned = materialise(owners.select("file", "line", "first").join(sizes.select("file", "first", reason.alias("reason")), ["file", "first"]))
    named = fragments.select("file", "line", "record").join(owned, ["file", "line"])
    parts = F.array_sort(F.collect_list(F.struct("line", "record")))
    joined = named.where("reason IS NULL").groupBy("file", "first").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
    bad = named.where("reason IS NOT NULL").select("file", "line", "record", "reason")
    return whole.unionByName(joined.select("file", F.col("first").alias("line"), "record", F.lit(None).cast("string").alias("reason"))).unionByName(bad)


def _header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    first = spark.read.option("lineSep", "\n").text(path).first()
    return next(csv.reader([first[0].lstrip("\ufeff").rstrip("\r")], delimiter=delimiter)) if first else []


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, header: bool = True, delimiter: str = ","
) -> Records:
    """A delimited text file, or a folder of them, whose quoted fields may hold line breaks.

    Without a schema every column is text and named by the header; with ``header`` the first line of every file is one. Malformed
    are records with more or fewer fields than columns, with values that the schema can't hold, with an opened quote that the
    file never closes, or of more than ``RECORD_BYTES``; the last two come in fragments.
    """
    if schema is None:
        if not header:
            raise ValueError("give a schema for files without a header")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, path, delimiter)])
    cut = cut_records(spark, path, delimiter)
    texts = cut.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("reason").isNotNull() | (F.col("record") != ""))
    if header:
        texts = texts.where("line > 0")
    wanted = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = F.when(F.col("reason").isNull(), F.from_csv("record", _ddl(wanted), options))
    read = materialise(texts.withColumn("row", parsed))
    good = F.col("reason").isNull() & F.col(f"row.{_CORRUPT}").isNull()
    rows = read.where(good).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    malformed = read.where(~good).select("file", "line", F.coalesce("reason", F.lit(FIELDS)).alias("reason"), "record")
    return Records(rows, malformed)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
