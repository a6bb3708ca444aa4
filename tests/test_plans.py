from __future__ import annotations

import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewlens.operators import dedup, joins, stats
from reviewlens.plans import quantiles
from reviewlens.plans.positions import with_position, with_running_total
from reviewlens.plans.quantiles import exact_quantiles
from reviewlens.plans.sizing import fits_broadcast, join_lookup, materialise
from reviewlens.session import shared_folder, temporary_tables


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, some under none."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}", rng.random() * 100) for i in range(3000)]
    return materialise(spark.createDataFrame(rows, "id int, key string, x double").repartition(6))


def test_positions_match_a_sort(skewed):
    placed = with_position(skewed, [F.col("x").desc(), F.col("id").asc()], "pos").collect()
    wanted = sorted(placed, key=lambda r: (-r.x, r.id))
    assert [r.pos for r in wanted] == list(range(3000))


def test_positions_in_groups_with_null_and_hot_keys(skewed):
    placed = with_position(skewed, [F.col("id").asc()], "pos", ["key"]).collect()
    seen: dict = {}
    for row in sorted(placed, key=lambda r: r.id):
        assert row.pos == seen.get(row.key, 0)
        seen[row.key] = row.pos + 1
    assert len(placed) == 3000


def test_running_total(skewed):
    rows = with_running_total(skewed, [F.col("id").asc()], "total", ["key"], F.col("id") % 5).collect()
    sums: dict = {}
    for row in sorted(rows, key=lambda r: r.id):
        sums[row.key] = sums.get(row.key, 0) + row.id % 5
        assert row.total == sums[row.key]


def test_exact_quantiles(spark, skewed):
    values = np.array([r.x for r in skewed.collect()])
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = {r.prob: r.value for r in exact_quantiles(skewed, ["x"], probs).collect()}
    for p in probs:
        assert found[p] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_exact_quantiles_with_a_coarse_sketch(spark, skewed, monkeypatch):
    # A sketch this coarse brackets a wide band, which the counting step has to resolve.
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    monkeypatch.setattr(quantiles, "SORTED_ROWS", 10)  # so that the running total is distributed
    monkeypatch.setattr(quantiles, "MARGINS", (0.01, 0.2, 1.0))
    values = np.array([r.x for r in skewed.collect()])
    found = {r.prob: r.value for r in exact_quantiles(skewed, ["x", "id"], [0.25, 0.5]).filter("column = 'x'").collect()}
    assert found[0.5] == pytest.approx(np.quantile(values, 0.5)) and found[0.25] == pytest.approx(np.quantile(values, 0.25))


def test_exact_quantiles_of_few_values(spark):
    for n in (1, 2, 3, 5):
        df = spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")
        found = {r.prob: r.value for r in exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
        assert found == {p: pytest.approx(np.quantile([i * i for i in range(n)], p)) for p in (0.25, 0.5, 0.75)}


def test_describe_of_heavy_ties_and_nulls(spark):
    df = spark.createDataFrame([(5.0, None)] * 90 + [(1.0, None)] * 5 + [(None, None)] * 5, "x double, y double")
    found = {r["column"]: r for r in stats.describe(df, ["x", "y"]).collect()}
    assert (found["x"]["count"], found["x"].p25, found["x"].min, found["x"].max) == (95, 5.0, 1.0, 5.0)
    assert found["y"]["count"] == 0 and found["y"].p50 is None


def test_size_check(spark):
    df = spark.range(100).withColumn("text", F.lit("x" * 1000))
    assert fits_broadcast(df, 100) and not fits_broadcast(df, 99) and not fits_broadcast(df, 100, 50_000)


@pytest.mark.parametrize("max_rows", [0, 1_000_000])
def test_lookup_join_is_the_same_with_and_without_broadcast(spark, skewed, max_rows):
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    joined = join_lookup(skewed, table, ["key"], "left", max_rows)
    plan = joined._jdf.queryExecution().toString()
    assert ("ResolvedHint" in plan or "strategy=broadcast" in plan) == (max_rows > 0)
    assert joined.count() == 3000 and joined.filter("v = 1").count() == 1000


@pytest.mark.parametrize("max_rows", [0, 1_000_000])
def test_mean_on_rows(skewed, max_rows):
    rows = stats.mean_on_rows(skewed, "key", "x", "m", max_rows).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.key, []).append(r.x)
    assert len(rows) == 3000
    for r in rows:
        assert r.m is None if r.key is None else r.m == pytest.approx(np.mean(groups[r.key]))


def test_dedup(skewed):
    keys = {r.key for r in skewed.collect()}
    first = dedup.keep_first(skewed, ["key"], ["id"]).collect()
    assert len(first) == len(keys) and min(r.id for r in first if r.key == "hot") == 0
    repeated = dedup.repeated_rows(skewed, ["key"], ["id"])
    assert repeated.count() == 3000 - len(keys) == dedup.repeated_count(skewed, ["key"]).first().repeated
    assert not {r.id for r in first} & {r.id for r in repeated.collect()}


def test_digest_tells_keys_apart(spark):
    rows = [("a", "bc", 1), ("ab", "c", 2), (None, "c", 3), ("", "c", 4), (None, "c", 5), ("-", "c", 6), ("a", "bc", 7)]
    df = spark.createDataFrame(rows, "x string, y string, i int")
    assert dedup.repeated_count(df, ["x", "y"], digest=True).first().repeated == 2
    assert sorted(r.i for r in dedup.repeated_rows(df, ["x", "y"], ["i"], digest=True).collect()) == [5, 7]
    assert sorted(r.i for r in dedup.keep_first(df, ["x", "y"], ["i"], digest=True).collect()) == [1, 2, 3, 4, 6]


def test_keep_first_limits_groups_ahead_of_the_shuffle(skewed):
    plan = dedup.keep_first(skewed, ["key"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_zero_fill_keeps_keys_outside_the_domain(spark):
    counts = spark.createDataFrame([(2, 5), (13, 1)], "month int, n long")
    filled = {r.month: r.n for r in joins.zero_fill(counts, "month", "n", 1, 12).collect()}
    assert filled == {**{m: 0 for m in range(1, 13)}, 2: 5, 13: 1}


def test_orphans_and_enrichment(spark):
    reviews = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "h string, i int")
    hotels = spark.createDataFrame([("a", "A"), ("c", None)], "h string, name string")
    assert sorted(r.i for r in joins.drop_orphans(reviews, hotels, "h", "name").collect()) == [1]
    assert {r.i: r.name for r in joins.enrich(reviews, hotels, "h", ["name"]).collect()} == {1: "A", 2: None, 3: None}


def test_histograms(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2.5, 9.9, 10, 10, 11, -1]] + [(None,)], "v double")
    unit = {r.low: r.n for r in stats.histogram_integer_edges(df, "v", 0, 10).collect()}
    assert unit == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 3}
    wide = [r.n for r in stats.histogram(df, "v", 4).orderBy("bin").collect()]
    counts, edges = np.histogram([0, 1, 2.5, 9.9, 10, 10, 11, -1], bins=4)
    assert wide == counts.tolist() and sum(wide) == 8
    flat = stats.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [(r.low, r.n) for r in flat] == [(2.5, 0), (3.0, 2)]


def test_frequencies_leave_out_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in stats.top_categories(df, "v", 1).collect()] == [("a", 2)]
    assert [r.share for r in stats.category_share(df, "v", 5).collect()] == [0.5, 0.5]


def test_against_average(spark):
    table = spark.createDataFrame([("A", 2.0, 1.0), ("B", 4.0, 1.0)], "name string, x double, y double")
    rows = joins.against_average(table.filter("name = 'A'"), table, ["x", "y"], ["name"]).collect()
    assert [tuple(r) for r in rows] == [("A", "x", 2.0, 3.0), ("A", "y", 1.0, 1.0)]


def test_temporary_tables_are_deleted(spark):
    with temporary_tables(spark):
        held = materialise(spark.range(3))
        path = held.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert os.path.exists(path) and held.count() == 3
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))


def test_vectors_count_with_their_numbers(spark):
    rows = [(i, Vectors.dense([0.0] * 2000)) for i in range(20)]
    df = spark.createDataFrame(rows, ["id", "v"])
    assert fits_broadcast(df, 100, 400_000) and not fits_broadcast(df, 100, 300_000)
