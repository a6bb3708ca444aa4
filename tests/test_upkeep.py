"""Factors, language profiles, heavy words, summaries, buckets and audits, against plain Python."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens import hotel
from reviewlens.catalog import ENTRIES
from reviewlens.functions.text import cloud_words
from reviewlens.operators import collab, factors, heavy, joins, language, sketches, stats
from reviewlens.operators.text import word_frequencies
from reviewlens.plans.audit import Audit
from reviewlens.plans.jobs import clean_entities, clean_reviews
from reviewlens.sources import bucketed, tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tabled = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain_best(users, items, k):
    out = []
    for u, v in users:
        best = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in items)[:k]
        out += [(u, r, i, round(-s, 6)) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    random = np.random.default_rng(1)
    rows = [(u, i, float(random.integers(1, 11))) for u in range(30) for i in random.choice(80, 25, replace=False).tolist()]
    rows += [(0, i % 80, float(random.integers(1, 11))) for i in range(600)]  # half of all ratings are one user's
    ratings = spark.createDataFrame(rows, "u int, i int, r double").repartition(3)
    return ratings, rows, collab.fit_als(ratings, "u", "i", "r", rank=5, iterations=15, regularisation=0.05)


def test_best_items_of_a_trained_model(spark, model):
    _, _, als = model
    users, items = ([(r["id"], r["features"]) for r in t.collect()] for t in (als.userFactors, als.itemFactors))
    got = factors.best_items(als.userFactors, als.itemFactors, 7, bucket=8, chunk=4)
    assert sorted((r["user"], r["rank"], r["item"], round(r["score"], 6)) for r in got.collect()) == plain_best(users, items, 7)
    one = factors.best_items(als.userFactors.where("id = 3"), als.itemFactors, 4, bucket=8)
    assert [r["item"] for r in one.orderBy("rank").collect()] == [i for u, r, i, _ in plain_best(users, items, 4) if u == 3]


def test_best_items_with_negative_scores_ties_and_few_items(spark):
    kind = "id int, features array<float>"
    users = [(1, [-1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])]
    items = [(i, [float(1 + i % 5), 0.0]) for i in range(20)]
    df, other = spark.createDataFrame(users, kind), spark.createDataFrame(items, kind)
    for k in (3, 50):
        got = factors.best_items(df, other, k, bucket=4, chunk=1)
        assert sorted((r["user"], r["rank"], r["item"], round(r["score"], 6) + 0.0) for r in got.collect()) == plain_best(users, items, k)
    assert factors.best_items(df.limit(0), other, 3).count() == 0
    assert factors.best_items(df, other.limit(0), 3).count() == 0


def test_users_meet_runs_of_buckets(spark):
    """One chunk of users goes to the items without a shuffle of items; more chunks meet runs of buckets, not every bucket."""
    random = np.random.default_rng(5)
    users, items = ([(i, random.normal(size=4).round(3).tolist()) for i in range(n)] for n in (40, 300))
    df, other = (spark.createDataFrame(t, "id int, features array<double>").repartition(3) for t in (users, items))
    for chunk in (8, 40):
        got = factors.best_items(df, other, 5, bucket=2, chunk=chunk)
        plan = got._jdf.queryExecution().toString()
        assert ("FlatMapCoGroupsInArrow" in plan) == (chunk == 8)
        assert chunk == 40 or "run" in plan
        assert sorted((r["user"], r["rank"], r["item"], round(r["score"], 6)) for r in got.collect()) == plain_best(users, items, 5)


def test_products_left_out_where_lengths_differ(spark):
    random = np.random.default_rng(2)
    rows = [(i, (random.normal(size=6) * 1.5 ** (-i / 40)).tolist()) for i in range(1000)]
    items = spark.createDataFrame(rows, "id int, features array<double>")
    done = factors.products_done(items.where("id % 10 = 0"), items, 5, bucket=50).first()
    assert done["all"] == 100 * 1000 and done["done"] < 0.4 * done["all"]


def test_folded_in_users_keep_their_factors(spark, model):
    ratings, rows, als = model
    known = {r["id"]: np.array(r["features"]) for r in als.userFactors.collect()}
    items = {r["id"]: np.array(r["features"], float) for r in als.itemFactors.collect()}
    for most in (10_000, 40):  # with the smaller one, user 0 is summed in several tasks
        got = {r["id"]: np.array(r["features"]) for r in factors.fold_in_users(ratings, als.itemFactors, "u", "i", "r", 0.05, most).collect()}
        assert set(got) == set(known)
        for u, v in got.items():
            mine = [(items[i], r) for w, i, r in rows if w == u]
            a, b = np.array([x for x, _ in mine]), np.array([r for _, r in mine])
            exact = np.linalg.solve(a.T @ a + 0.05 * len(b) * np.eye(5), a.T @ b)
            assert np.abs(v - exact).max() < 1e-8


def test_a_known_user_folded_in_keeps_its_factor(spark, model):
    """After training has settled, least squares with the final items give the stored factor again."""
    ratings, _, _ = model
    als = collab.fit_als(ratings, "u", "i", "r", rank=3, iterations=200, regularisation=0.1)
    known = {r["id"]: np.array(r["features"]) for r in als.userFactors.collect()}
    got = {r["id"]: np.array(r["features"]) for r in factors.fold_in_users(ratings, als.itemFactors, "u", "i", "r", 0.1).collect()}
    assert max(np.abs(got[u] - known[u]).max() for u in known) < 1e-2 * max(np.abs(v).max() for v in known.values())


def test_unknown_items_and_missing_ratings_are_skipped(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "id int, features array<float>")
    rows = spark.createDataFrame([(7, 1, 4.0), (7, 99, 1.0), (8, 99, 1.0), (9, 1, None), (None, 1, 2.0)], "u int, i int, r double")
    assert [(r["id"], r["features"]) for r in factors.fold_in_users(rows, items, "u", "i", "r", 1.0).collect()] == [(7, [2.0, 0.0])]


@tabled
def test_profiles_tell_languages_better_than_the_vote(spark):
    rows = ENTRIES["language_by_profile"].run(spark, FOLDER).where("doc_id % 4 = 2").collect()
    votes = {r["doc_id"]: r["vote"] for r in ENTRIES["language_vote"].run(spark, FOLDER).collect()}
    assert sum(r["guess"] == r["lang"] for r in rows) >= sum(votes[r["doc_id"]] == r["lang"] for r in rows)
    assert sum(r["guess"] == r["lang"] for r in rows) > 0.97 * len(rows)


def test_profiles_count_pieces_without_sorting_texts(spark):
    df = spark.createDataFrame([("aba aba", "x"), ("ab", "x"), ("b", None)], "t string, l string")
    made = language.learn_profiles(df, "t", "l")
    assert [(r["gram"], r["rank"]) for r in made.orderBy("rank").limit(2).collect()] == [(" ab", 0), ("aba", 1)]
    assert "array_sort" not in made._jdf.queryExecution().toString()


def test_texts_without_letters_have_no_language(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de"), (3, "12 !", None), (4, None, "en"), (5, "", None), (6, "the", None)], "k int, t string, l string")
    found = language.nearest_language(df, ["k"], "t", language.learn_profiles(df, "t", "l"))
    assert {r["k"]: r["lang"] for r in found.collect()} == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: "en"}
    kept = language.keep_languages_by_profile(df, ["k"], "t", language.learn_profiles(df, "t", "l"), ["en"])
    assert {r["k"] for r in kept.collect()} == {1, 3, 4, 5, 6}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcdefgh", min_size=1, max_size=1), max_size=200), st.integers(2, 6), st.integers(1, 20))
def test_summary_counts_are_within_their_error(words, capacity, step):
    summary = heavy.Summary(capacity)
    for at in range(0, len(words), step):
        summary.add(Counter(words[at : at + step]))
    exact = Counter(words)
    assert len(summary.counts) <= capacity
    assert all(summary.counts.get(w, 0) <= n <= summary.counts.get(w, 0) + summary.error for w, n in exact.items())


@pytest.mark.parametrize("capacity", [6, 40, 10_000])
def test_heavy_words_are_the_most_frequent(spark, capacity):
    random = np.random.default_rng(3)
    texts = [(" ".join(f"w{x}s" if x % 3 else f"w{x}" for x in random.zipf(1.3, 40) if x < 5000),) for _ in range(400)]
    df = spark.createDataFrame(texts, "text string").repartition(5)
    words = df.select(cloud_words(F.col("text")).alias("w"))
    got = heavy.heavy_frequencies(words, "w", 25, capacity)
    want = word_frequencies(df, "text", n=25)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = Counter(w for r in words.collect() for w in r["w"])
    assert [tuple(r) for r in heavy.heavy_words(words, "w", 10, capacity).collect()] == sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_heavy_words_count_only_candidates(spark):
    rows = [(["often"] * 3 + [f"rare{i}"],) for i in range(3000)]
    df = spark.createDataFrame(rows, "w array<string>").repartition(3)
    assert heavy.heavy_candidates(df, "w", 1, capacity=100).count() < 150
    assert heavy.heavy_candidates(df, "w", 5, capacity=100) is None  # the fifth is as rare as words that went
    assert heavy.heavy_words(df, "w", 1, capacity=100).first()["n"] == 9000
    assert heavy.heavy_words(df.limit(0), "w", 3).count() == 0


def test_summaries_merge_to_those_of_all_rows(spark, tmp_path):
    random = np.random.default_rng(4)
    rows = [(["a", "b"][i % 2], i % 7, float(random.normal(10, 3)) if i % 11 else None, int(random.integers(0, 500))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, day int, v double, thing int").repartition(4)
    path, small = str(tmp_path / "sketches"), str(tmp_path / "compact")
    for part in (df.where("day < 3"), df.where("day >= 3 AND thing < 100"), df.where("day >= 3 AND thing >= 100")):
        sketches.append(part, path, ["g"], "day", "v", "thing")
    sketches.compact(spark, path, ["g"], "day", small)
    assert spark.read.parquet(small).count() == 14 < spark.read.parquet(path).count()
    for stored in (path, small):
        for r in sketches.report(spark.read.parquet(stored), ["g"], stats.QUARTILES).collect():
            values = np.array([v for g, _, v, _ in rows if g == r["g"] and v is not None])
            assert r["count"] == len(values) and r["min"] == values.min() and r["max"] == values.max()
            assert r["mean"] == pytest.approx(values.mean()) and r["std"] == pytest.approx(values.std(ddof=1))
            for name, p in stats.QUARTILES.items():
                assert abs((values <= r[name]).mean() - p) < sketches.rank_error()
            assert abs(r["distinct"] - 500) < 25


def test_an_update_reads_new_rows_only(spark, tmp_path):
    stored, path = str(tmp_path / "stored"), str(tmp_path / "sketches")
    spark.createDataFrame([("a", 1, 1.0, 1)], "g string, day int, v double, thing int").write.parquet(stored)
    new = spark.read.parquet(stored)
    sketches.append(new, path, ["g"], "day", "v", "thing")
    before = set(os.listdir(path))
    sketches.append(new, path, ["g"], "day", "v", "thing")
    assert before < set(os.listdir(path))
    assert set(f.rsplit("/", 2)[1] for f in sketches.summarise(new, ["g", "day"], "v", "thing").inputFiles()) == {"stored"}
    got = sketches.report(spark.read.parquet(path), [], {"p50": 0.5}).first()
    assert (got["count"], got["p50"], got["distinct"], got["std"]) == (2, 1.0, 1, 0.0)


def test_summaries_of_nothing_but_nulls(spark):
    df = spark.createDataFrame([("a", None, None)], "g string, v double, thing int")
    got = sketches.report(sketches.summarise(df, ["g"], "v", "thing"), ["g"], {"p50": 0.5}).first()
    assert (got["count"], got["mean"], got["std"], got["p50"], got["distinct"]) == (0, None, None, None, 0)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_buckets_need_no_shuffle(spark):
    rows = spark.createDataFrame([(i % 50 if i % 17 else None, i, float(i % 9)) for i in range(2000)], "k int, i int, s double")
    entities = spark.createDataFrame([(k, f"n{k}" if k % 5 else None, "x") for k in range(0, 60, 2)], "k int, name string, other string")
    a, b = (bucketed.write_bucketed(t, "k", 4) for t in (rows, entities))
    same = lambda x, y: x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    for mine, plain in (
        (bucketed.enrich_bucketed(spark, a, b, "k", ["name"]), joins.enrich(rows, entities, "k", ["name"])),
        (bucketed.drop_orphans_bucketed(spark, a, b, "k", "name"), joins.drop_orphans(rows, entities, "k", "name")),
        (bucketed.mean_on_rows_bucketed(spark, a, "k", "s", "m"), stats.mean_on_rows(rows, "k", "s", "m")),
    ):
        assert shuffles(mine) == []
        assert same(mine.select(plain.columns), plain)


def test_means_are_not_of_watched_rows(spark, monkeypatch):
    """The pass for the means observes nothing: every watched step is in the plan of the result only."""
    text, seen = tables.text_schema(hotel.REVIEW_COLUMNS), []
    row = ("1", "1_1", "r1", "An", None, "Solo", "Twin", "", "", "8,0", "Fine")
    known = tables.local_table(spark, [("1_1", "Name")], tables.text_schema([hotel.ID, hotel.NAME]))
    lookup = stats.join_lookup
    monkeypatch.setattr(stats, "join_lookup", lambda rows, table, *a, **b: seen.append(table._jdf.queryExecution().toString()) or lookup(rows, table, *a, **b))
    made = clean_reviews(tables.local_table(spark, [row], text), known, [F.col("num").cast("int")], audit=Audit())
    assert len(seen) == 1 and "CollectMetrics" not in seen[0]
    assert made.select("Mean_Reviewer_Score").first()[0] == 8.0


def test_audit_counts_what_the_jobs_drop(spark, tmp_path):
    text = tables.text_schema(hotel.REVIEW_COLUMNS)
    rows = [
        ("1", "1_1", "r1", "An", None, "Solo", "Twin", "", "Đã nhận xét vào 12 tháng 8 2023", "8,0", "Fine"),
        ("2", "1_1", "r2", "An", None, "Solo", "Twin", "", "Đã nhận xét vào 12 tháng 8 2023", "na", "Again"),
        ("3", "9_9", "r4", "Cy", "VN", "Pair", "Suite", "", None, "6,0", "Orphan"),
        ("4", "1_1", "r6", None, "VN", "Pair", "Suite", "", None, "6,0", "Nameless"),
        ("5", "1_1", "r7", "Eb", "VN", "Pair", "Suite", "", None, "6,0", None),
    ]
    entity = ("1_1", "Name", "4", "Road", None, *["8,5"] * 4, "", "na", "1", "12")
    entities = tables.local_table(spark, [entity], tables.text_schema(hotel.ENTITY_COLUMNS))
    audit, other = Audit(), Audit()
    cleaned = clean_entities(entities, audit=other)
    made = clean_reviews(tables.local_table(spark, rows, text), cleaned, [F.col("num").cast("int")], audit=audit)
    tables.write_parquet(made, str(tmp_path / "reviews"))
    tables.write_parquet(cleaned, str(tmp_path / "entities"))
    counts = {(s, m): n for s, m, n in audit.counts()}
    assert [counts[s, "rows"] for s in ("read", "present", "known", "unique")] == [5, 3, 2, 1]
    assert [counts[s, "removed"] for s in ("present", "known", "unique")] == [2, 1, 1]
    assert (counts["read", "nulls of Body"], counts["read", "dirty Score"], counts["present", "unscored"], counts["known", "undated"]) == (1, 1, 1, 0)
    found = {m: n for _, m, n in other.counts()}
    assert found["rows"] == 1 and found["nulls of Hotel_Description"] == 1 and sum(n for m, n in found.items() if m.startswith("dirty")) == 2
    assert audit.report(spark).count() == len(counts)
