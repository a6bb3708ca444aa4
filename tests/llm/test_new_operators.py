"""Periodic runs, hard negatives and exact top-k: against brute force, and on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.llm import negatives, pivots, queries, runs


def plain_runs(words):
    """Runs by comparing every lag."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


parts = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 8)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, min_size=1, max_size=4))
def test_runs_as_every_lag(texts):
    words = [[w.encode() for p, n in t for w in p * n] for t in texts]
    found, bounds = runs.runs_of(words)
    for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True):
        assert [tuple(r) for r in found[a:b].tolist()] == plain_runs(w)


def test_runs_of_odd_texts(spark):
    long = "x " + "la la di " * 200_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "ha " * 6), (4, "ha " * 5), (None, "a b a b a b a b"), (5, long), (6, "ha " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("period", F.lit(2))
    got = runs.find_runs(docs).collect()
    assert {"start", "period", "runs", "collapsed"} <= set(got[0].asDict()) and len(got) == len(rows)
    shown = sorted((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got if r["doc_id"] and r["text"])
    assert shown == [
        (3, [], ""), (4, [], "ha ha ha ha ha"), (4, [(0, 6, 1)], "ha"), (5, [(1, 600_000, 3)], "x la la di"), (6, [(0, 6, 1)], "ha"),
    ]
    assert [([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got if r["doc_id"] is None] == [([(0, 8, 2)], "a b")]
    assert [(r["runs"], r["collapsed"]) for r in got if not r["text"]] == [([], "")] * 2
    assert runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs.withColumnRenamed("text", "collapsed"), text="collapsed")


def test_longest_run_has_the_smallest_start(spark):
    row = spark.sql("SELECT array(struct(5L AS start, 8L AS length, 2L AS period), struct(1L AS start, 8L AS length, 1L AS period)) AS r, cast(array() AS %s) AS e" % runs.RUN)
    got = row.select(runs.longest(F.col("r")).alias("a"), runs.longest(F.col("e")).alias("b")).first()
    assert (tuple(got["a"]), got["b"]) == ((1, 8, 1), None)


def test_planting_needs_an_id_and_words(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, None), (2, "a  b")] + [(i, " ".join(map(str, range(50)))) for i in range(3, 60)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in queries.planted(docs).collect()}
    assert (got[None], got[1], got[2]) == ("a b c", None, "a  b")
    assert sum(len(set(t.split())) < 50 for i, t in got.items() if i and i > 2) > 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 90), st.integers(1, 90), st.integers(1, 90), st.integers(0, 2**32 - 1))
def test_strassen_is_exact(m, k, n, seed):
    random = np.random.default_rng(seed)
    a, b = random.integers(-(2**25), 2**25, (m, k)), random.integers(-(2**25), 2**25, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()


def test_strassen_where_only_the_result_fits():
    a, b = np.full((70, 70), 2**62, np.int64), np.zeros((70, 70), np.int64)
    b[0] = 1
    assert (negatives.strassen(a, b) == 2**62).all()


def integer(vector, scale):
    return [int(np.floor(scale * float(x))) for x in vector]


ODD = [
    (100, [0.5, 0.25], 1), (100, [0.5, 0.5], 1), (200, [0.5, 0.5], 2), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.45, 0.5], 2), (3, [0.45, 0.5], 2),
    (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 2), (7, [None, 1.0], 1), (None, [0.5, 0.5], 1), (8, [0.5, 0.5], None),
    (300, [], 1), (9, [], 2), (10, [], 1), (11, [1e30, 1.0], 1), (12, [0.5], 1), (13, [-1.0, -1.0], 1), (400, [0.0, 0.0], 3), (14, [0.46, 0.46], 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label long").repartition(4)
    return df.select("*", *[F.lit(1).alias(c) for c in ("row", "v", "id", "dim", "rank", "node", "score", "anchor")])


def usable(rows, scale, label):
    out = []
    for i, v, l in rows:
        if i is None or v is None or (label and l is None) or any(x is None or not np.isfinite(x) for x in v):
            continue
        if sum((abs(scale * x) + 1) ** 2 for x in v) < 2.0**62:
            out.append((i, integer(v, scale), l))
    return out


def plain_negatives(rows):
    rows, out = usable(rows, 256, True), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for n, (a, v, label) in enumerate(rows):
        if a % 100:
            continue
        others = [(dot(v, w), i, l) for m, (i, w, l) in enumerate(rows) if m != n and len(w) == len(v)]
        for ps, p in sorted(((s, i) for s, i, l in others if l == label), key=lambda x: (-x[0], x[1]))[:5]:
            near = sorted(((-s, i) for s, i, l in others if l != label and 80 * ps <= 100 * s <= 100 * ps))[:5]
            out += [(a, p, r, i, ps, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_negatives_on_odd_rows(spark, odd):
    got = negatives.hard_negatives(odd, F.col("vec_id") % 100 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(ODD)
    assert negatives.hard_negatives(odd.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(odd, F.lit(None).cast("boolean")).count() == 0


def test_negatives_in_many_tiles(spark, monkeypatch):
    """Small tiles, one label and one vector with a third of all rows, ties."""
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "ROWS", 16)
    random = np.random.default_rng(5)
    rows = [(i, ([0.5] * 4 if i % 3 == 0 else (random.integers(0, 4, 4) / 4).tolist()), 1 if i % 3 == 1 else int(random.integers(0, 4))) for i in range(0, 900, 5)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def plain_top(rows, scale=1024, k=10):
    seen = {(i, tuple(v)) for i, v, _ in usable(rows, scale, False)}
    out = []
    for a, v in seen:
        if a % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in seen if (i, w) != (a, v) and len(w) == len(v))[:k]
            out += [(a, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_products_on_odd_rows(spark, odd):
    got = pivots.top_products(odd, F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_top(ODD)
    assert pivots.top_products(odd.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert pivots.top_products(odd, F.lit(None).cast("boolean")).count() == 0


def test_top_products_in_many_blocks(spark, monkeypatch):
    """Small blocks, vectors around few centres, one vector with a third of all rows."""
    for name, size in (("BLOCK", 16), ("CHUNK", 2), ("BLOCKS", 3), ("RANGES", 4), ("FIRST", 4)):
        monkeypatch.setattr(pivots, name, size)
    random = np.random.default_rng(6)
    centres = random.normal(size=(6, 8))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 6] + random.normal(size=8) / 50).tolist(), None) for i in range(0, 3000, 4)]
    got = pivots.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows)


def test_pivots_skip_what_cannot_be_among_the_best():
    random = np.random.default_rng(7)
    centres = random.normal(size=(20, 16)) * 200
    rows = np.floor(np.concatenate([c + random.normal(size=(100, 16)) for c in centres])).astype(np.int64)
    table = pivots.pivot_distances(rows.astype(float), pivots.choose_pivots(rows.astype(float)))
    ids = np.arange(len(rows))
    done = 0
    for q in range(0, len(rows), 50):
        scores, found, _, evaluated = pivots.search(rows[q], table[q], pivots.LEAST, rows, table, ids, ids, 10)
        exact = rows @ rows[q]
        order = np.lexsort((ids, -exact))[:10]
        assert (found == order).all() and (scores == exact[order]).all()
        done += evaluated
    assert done < 0.5 * len(rows) * len(range(0, len(rows), 50))
