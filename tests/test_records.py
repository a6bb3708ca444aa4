"""Delimited files cut over many tasks, against Python's reader and Spark's own."""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.sources import records
from reviewlens.sources.tables import read_raw_csv, text_schema

field = st.text(alphabet='ab",\n ', max_size=8)


def inside_after(text: str) -> bool:
    """Character by character."""
    inside, at_start, i = False, True, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"' and text[i + 1 : i + 2] == '"':
            i += 1
        elif inside and c == '"':
            inside = False
        elif not inside and at_start and c == '"':
            inside = True
        at_start = not inside and c in ",\n"
        i += 1
    return inside


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab",', max_size=12))
def test_a_line_outside_and_inside_quotes(line):
    assert records.ends_inside(line, False) == inside_after(line)
    assert records.ends_inside(line, True) == inside_after('"' + "x" + "\n" + line)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(field, min_size=2, max_size=3), max_size=6), st.booleans())
def test_states_of_lines_are_those_of_the_whole_text(rows, first):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    lines = out.getvalue().split("\n")
    effects = records._effects(pa.array(lines), ",")
    want = [inside_after("\n".join(lines[:i]) + "\n" if i else "") for i in range(len(lines) + 1)]
    assert records.states_before(*effects, False).tolist() == want
    # Any cut of the lines composes to the same states.
    for cut in range(len(lines)):
        head = [records.states_before(*(e[:cut] for e in effects), s)[-1] for s in (False, True)]
        assert records.states_before(*(e[cut:] for e in effects), bool(head[0])).tolist() == want[cut:]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(tmp_path, rows, tail="", end="\n"):
    path = tmp_path / "raw.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)
        file.write(tail)
    return str(path)


def texts(count, seed=1):
    random = np.random.default_rng(seed)
    pieces = ["word", "Đà Nẵng", '"', "\n", ",", "\n\n", " ", "x" * 40]
    return [[str(i), "".join(random.choice(pieces, random.integers(1, 30)))] for i in range(count)]


def test_one_file_by_many_tasks(spark, tmp_path, small_splits):
    rows = texts(600)
    rows[300][1] = "long\n" * 3000  # spans several splits
    path = written(tmp_path, [["id", "body"], *rows])
    got = records.read_records(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    assert got.rows.columns == ["id", "body"] and got.malformed.count() == 0
    assert sorted((r["id"], r["body"]) for r in got.rows.collect()) == sorted(map(tuple, rows))
    plain = read_raw_csv(spark, path, text_schema(["id", "body"]), multiline=True)
    assert got.rows.exceptAll(plain).isEmpty() and plain.exceptAll(got.rows).isEmpty()


def test_malformed_records_are_kept(spark, tmp_path, small_splits):
    rows = texts(50)
    path = written(tmp_path, [["id", "body"], *rows], 'a,b,c\n\nonly\r\n5" pipe,"ok"\n"never\nclosed')
    got = records.read_records(spark, path)
    assert sorted((r["id"], r["body"]) for r in got.rows.collect()) == sorted([*map(tuple, rows), ('5" pipe', "ok")])
    first = 1 + sum(1 + r[1].count("\n") for r in rows)
    found = sorted(((r["line"], r["reason"], r["record"]) for r in got.malformed.collect()))
    assert found == [
        (first, records.FIELDS, "a,b,c"), (first + 2, records.FIELDS, "only"), (first + 4, records.NOT_CLOSED, '"never\nclosed'),
    ]


def test_types_line_ends_and_several_files(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_bytes(f'n,body\r\n{i},"a\r\nb"\r\nx{i},c\r\n'.encode())
    got = records.read_records(spark, str(folder), spark.createDataFrame([], "n int, body string").schema)
    assert sorted(tuple(r) for r in got.rows.collect()) == [(i, "a\r\nb") for i in range(3)]
    assert sorted(r["record"] for r in got.malformed.collect()) == ["x0,c", "x1,c", "x2,c"]
    assert {r["line"] for r in got.malformed.select("line").collect()} == {3}


def test_long_records_and_empty_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORD_BYTES", 1000)
    monkeypatch.setattr(records, "FRAGMENT_BYTES", 100)
    path = written(tmp_path, [["id", "body"], ["1", "y\n" * 300], ["2", "z\n" * 700], ["3", "ok"]])
    got = records.read_records(spark, path)
    assert sorted(tuple(r) for r in got.rows.collect()) == [("1", "y\n" * 300), ("3", "ok")]
    bad = got.malformed.orderBy("line").collect()
    assert {r["reason"] for r in bad} == {records.TOO_LONG} and "\n".join(r["record"] for r in bad) == '"2","' + "z\n" * 700 + '"'
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert records.read_records(spark, str(empty), text_schema(["a"])).rows.count() == 0
    with pytest.raises(ValueError):
        records.read_records(spark, path, header=False)
