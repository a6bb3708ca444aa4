from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from reviewlens.operators import collab, features, hybrid, training


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, i, float((u * 7 + i * 3) % 5 + 1)) for u in range(12) for i in range(15) if (u + i) % 4]
    return spark.createDataFrame(rows, "user int, item int, score double").repartition(4)


@pytest.fixture(scope="module")
def model(ratings):
    return collab.fit_als(ratings, "user", "item", "score", rank=5, iterations=5)


def test_dense_index_by_frequency_then_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", "c", "a", "d", "d", None]], "v string")
    assert {r.v: r.i for r in collab.dense_index(df, "v", "i").collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}
    assert collab.with_index(df, "v", "i").count() == 6


def test_hash_split_does_not_depend_on_partitioning(ratings):
    train, test = collab.hash_split(ratings, ["user", "item"])
    again, _ = collab.hash_split(ratings.repartition(7, "score"), ["user", "item"])
    assert train.count() + test.count() == ratings.count()
    assert sorted(map(tuple, train.collect())) == sorted(map(tuple, again.collect()))
    assert 0.6 < train.count() / ratings.count() < 0.95
    parts = collab.random_split(ratings)
    assert parts[0].count() + parts[1].count() == ratings.count()


def test_clean_ratings(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (1, 2, math.nan), (None, 1, 1.0), (2, 2, None)], "u int, i int, r double")
    assert collab.clean_ratings(df, "u", "i", "r").count() == 2
    assert [tuple(r) for r in collab.clean_ratings(df, "u", "i", "r", "avg").collect()] == [(1, 1, 3.0)]


def test_als_beats_the_global_mean_on_training_rows(ratings, model):
    scored = collab.predict(model, ratings)
    mean = ratings.agg(F.avg("score")).first()[0]
    base = math.sqrt(ratings.agg(F.avg(F.pow(F.col("score") - mean, 2))).first()[0])
    assert collab.evaluate_rmse(scored, "score") < base
    assert scored.filter(F.isnan("prediction")).count() == 0


def test_unseen_users_get_no_prediction(spark, model):
    rows = spark.createDataFrame([(0, 1, 1.0), (999, 1, 1.0)], "user int, item int, score double")
    assert [r.user for r in collab.predict(model, rows).collect()] == [0]


def test_recommendations(spark, ratings, model):
    items = ratings.select("item").distinct().withColumn("name", F.concat(F.lit("i"), F.col("item").cast("string")))
    one = collab.recommend_for_user(model, items, 3, 4, ["name"]).collect()
    assert len(one) == 4 and [r.prediction for r in one] == sorted((r.prediction for r in one), reverse=True)
    everyone = collab.recommend_for_users(model, 4, items=items)
    assert everyone.count() == 48
    mine = everyone.filter("user = 3").orderBy("rank").collect()
    assert [r.item for r in mine] == [r.item for r in one] and mine[0].name == one[0].name
    some = collab.recommend_for_users(model, 2, spark.createDataFrame([(1,)], "user int"))
    assert some.count() == 2


def test_model_roundtrip(model, tmp_path):
    collab.save_model(model, str(tmp_path / "m"))
    collab.save_model(model, str(tmp_path / "m"))
    read = collab.load_model(str(tmp_path / "m"))
    assert read.rank == model.rank and read.itemFactors.count() == model.itemFactors.count()


def test_item_vectors_equal_hashing_the_joined_text(spark):
    split = spark.createDataFrame([(1, "sea view"), (1, "pool"), (2, "hill view"), (3, None)], "item int, text string")
    whole = spark.createDataFrame([(1, "sea view pool"), (2, "hill view")], "item int, text string")
    mine = {r.item: r.tfidf_features.toArray().tolist() for r in hybrid.item_text_vectors(split, "item", "text", 64).collect()}
    _, made = features.hashed_text_features(whole, "text", features=64)
    assert mine == {r.item: r.tfidf_features.toArray().tolist() for r in made.collect()}


def test_hybrid(spark):
    weights = spark.createDataFrame([(1, "sea", 1.0), (2, "hill", 1.0), (3, "sea", 0.6), (3, "hill", 0.8)], "item int, term string, weight double")
    train = spark.createDataFrame([("u", 1, 2.0), ("u", 1, 1.0)], "user string, item int, score double")
    pairs = spark.createDataFrame([("u", 2, 5.0), ("u", 3, 3.0), ("v", 3, 1.0)], "user string, item int, prediction double")
    profiles = hybrid.user_profiles(train, weights, "user", "item", "score")
    assert [tuple(r) for r in profiles.collect()] == [("u", "sea", 3.0)]
    contents = hybrid.content_scores(pairs, profiles, weights, "user", "item")
    scores = {(r.user, r.item): (r.content, r.score) for r in hybrid.hybrid_scores(pairs, contents, "user", "item").collect()}
    assert scores["u", 2] == pytest.approx((0.0, 0.7)) and scores["u", 3] == pytest.approx((0.6, 0.35 + 0.18))
    assert scores["v", 3] == pytest.approx((0.0, 0.0))
    joined = hybrid.hybrid_join(pairs, spark.createDataFrame([(3, "x")], "item int, content string"), "item")
    assert joined.count() == 3 and joined.filter("content IS NULL").count() == 1


def test_hashed_pipeline_options(spark):
    df = spark.createDataFrame([("Big  Pool the",), ("pool",)], "text string")
    model, made = features.hashed_text_features(df, "text", features=32, stop_words=["big"], pattern=r"\s+")
    assert made.first().filtered == ["pool", "the"] and len(model.stages) == 4


def _factors(model):
    return [{r["id"]: r["features"] for r in t.collect()} for t in (model.userFactors, model.itemFactors)]


@pytest.mark.parametrize("cells", [training.CELLS, 100])
def test_few_users_train_as_in_mllib_without_its_iterations(spark, monkeypatch, cells):
    """MLlib's iterations send every item's factor to each block of users; few users need none of them, and get the same model."""
    random = np.random.default_rng(3)
    rows = [(int(u) - 40, int(i) * 3, float(random.integers(1, 50))) for u, i in random.integers([13, 150], size=(900, 2)) ** [2, 1]]
    rows += [(-40, 3, float(n % 7)) for n in range(300)] + [(7, 9999, 4.0)]  # pairs that come often, an item of one rating
    df = spark.createDataFrame(rows, "user int, item int, score double").repartition(5)
    made, fit = [], ALS._fit
    monkeypatch.setattr(ALS, "_fit", lambda self, ratings: made.append((self.getMaxIter(), ratings.count())) or fit(self, ratings))
    monkeypatch.setattr(training, "CELLS", cells)
    mine = collab.fit_als(df, "user", "item", "score", rank=4, iterations=6, blocks=3)
    assert made == [(0, df.select("user").distinct().count())]
    monkeypatch.setattr(collab, "SUMS", 0)
    whole = collab.fit_als(df, "user", "item", "score", rank=4, iterations=6, blocks=3)
    assert made[1:] == [(6, df.count())]
    for a, b in zip(_factors(mine), _factors(whole), strict=True):
        assert a.keys() == b.keys()
        assert np.array([a[k] for k in b]) == pytest.approx(np.array(list(b.values())), abs=1e-4)
    assert {p.name: v for p, v in mine.extractParamMap().items()} == {p.name: v for p, v in whole.extractParamMap().items()}
    assert mine.rank == 4 and mine.userFactors.dtypes == whole.userFactors.dtypes and mine.itemFactors.dtypes == whole.itemFactors.dtypes


@pytest.mark.parametrize("bad", [(None, 1, 1.0), (1, None, 1.0), (1, 1, None), (1, 1, math.nan)])
def test_bad_ratings_fail_as_in_mllib(spark, bad):
    df = spark.createDataFrame([bad, (1, 2, 3.0), (2, 2, 1.0)], "user int, item int, score double")
    with pytest.raises(Exception, match="MUST NOT be Null"):
        collab.fit_als(df, "user", "item", "score", rank=2, iterations=1)
