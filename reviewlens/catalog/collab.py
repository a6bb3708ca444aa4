"""Queries on dense ids, splits, ALS and the hybrid score."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reviewlens.catalog.base import REVIEWS_SQL, Registry, quoted, reviews, rounded, table, texts
from reviewlens.functions.text import LANGUAGE_WORDS, terms
from reviewlens.operators import collab, factors, features, hybrid, stats
from reviewlens.plans.sizing import materialise
from reviewlens.session import shared_folder

ENTRIES = Registry()
KEY = ("ordr", "item", "nights", "score")
_KEY_SQL = "CAST(ordr AS VARCHAR), CAST(item AS VARCHAR), CAST(nights AS VARCHAR), CAST(CAST(score AS INTEGER) AS VARCHAR)"
_MARK_SQL = f"CAST(('0x' || left(md5(concat_ws('|', '{collab.SEED}', {_KEY_SQL})), 8)) AS BIGINT) % 100 < 80"


@ENTRIES.add(f"""
WITH {REVIEWS_SQL}, c AS (SELECT item, count(*) AS n FROM reviews GROUP BY item)
SELECT item, CAST(row_number() OVER (ORDER BY n DESC, item) - 1 AS INTEGER) AS item_id FROM c
""")
def string_index(spark, folder):
    return collab.dense_index(reviews(spark, folder), "item", "item_id")


@ENTRIES.add(f"""
WITH {REVIEWS_SQL}, c AS (SELECT user, count(*) AS n FROM reviews GROUP BY user),
i AS (SELECT user, CAST(row_number() OVER (ORDER BY n DESC, user) - 1 AS INTEGER) AS user_id FROM c)
SELECT ordr, item, nights, user, user_id FROM reviews JOIN i USING (user)
""")
def string_index_rows(spark, folder):
    return collab.with_index(reviews(spark, folder).select("ordr", "item", "nights", "user"), "user", "user_id")


def _split(spark, folder):
    # Whole scores as integers, so that the key reads the same in both languages.
    rows = reviews(spark, folder).withColumn("whole", F.col("score").cast("int"))
    return collab.hash_split(rows, ["ordr", "item", "nights", "whole"])


@ENTRIES.add(f"""
WITH {REVIEWS_SQL} SELECT ordr, item, nights, score, {_MARK_SQL} AS train FROM reviews
""")
def hash_split(spark, folder):
    train, test = _split(spark, folder)
    marked = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return marked.select(*KEY, "train")


@ENTRIES.add(f"""
WITH {REVIEWS_SQL}, s AS (SELECT *, {_MARK_SQL} AS train FROM reviews)
SELECT 'train' AS part, count(*) FILTER (train) AS rows FROM s UNION ALL SELECT 'test', count(*) FILTER (NOT train) FROM s
""")
def split_counts(spark, folder):
    train, test = _split(spark, folder)
    named = [stats.row_count(part).withColumn("part", F.lit(name)) for name, part in (("train", train), ("test", test))]
    return named[0].unionByName(named[1])


# A mean per item stands in for the factor model where SQL has to give the same numbers.
def _mean_predictions(spark, folder):
    train, test = _split(spark, folder)
    means = stats.mean_per_entity(train, "item", "score", "prediction")
    return test.join(means, "item")


_MEANS_SQL = f"""{REVIEWS_SQL}, s AS (SELECT *, {_MARK_SQL} AS train FROM reviews),
means AS (SELECT item, avg(score) AS prediction FROM s WHERE train GROUP BY item),
predictions AS (SELECT s.*, prediction FROM s JOIN means USING (item) WHERE NOT train)"""


@ENTRIES.add(f"WITH {_MEANS_SQL} SELECT round(sqrt(avg((score - prediction) ** 2)), 6) AS rmse FROM predictions")
def rmse_mean_model(spark, folder):
    return rounded(stats.rmse(_mean_predictions(spark, folder), "score", "prediction"), 6, "rmse")


# Item texts: the words of a part's name, brand and type.
def _item_texts(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")
    )


def _item_weights(spark, folder):
    texts = _item_texts(spark, folder).withColumnRenamed("item", "doc")
    weights = features.tfidf(features.term_counts(texts, ["doc"], ["text"], terms, unique=True), texts)
    return materialise(weights.withColumnRenamed("doc", "item"))


_ITEM_WEIGHTS_SQL = r"""
texts AS (SELECT p_partkey AS item, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part),
counts AS (SELECT item, term, count(*) AS tf FROM (SELECT item, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM texts) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM texts) + 1.0) / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY term),
raw AS (SELECT item, term, tf * idf AS raw FROM counts JOIN idf USING (term)),
weights AS (SELECT item, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item)) AS weight FROM raw)"""


@ENTRIES.add(f"""
WITH {_MEANS_SQL}, {_ITEM_WEIGHTS_SQL},
contents AS (SELECT item, count(*) AS terms, round(max(weight), 6) AS top_weight FROM weights GROUP BY item)
SELECT ordr, nights, predictions.item, score, round(prediction, 6) AS prediction, terms, top_weight FROM predictions LEFT JOIN contents USING (item)
""")
def hybrid_join(spark, folder):
    contents = _item_weights(spark, folder).groupBy("item").agg(
        F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top_weight")
    )
    predictions = _mean_predictions(spark, folder).select("ordr", "nights", "item", "score", "prediction")
    return rounded(hybrid.hybrid_join(predictions, contents, "item"), 6, "prediction")


@ENTRIES.add(f"""
WITH {_MEANS_SQL}, {_ITEM_WEIGHTS_SQL},
liked AS (SELECT user, item, sum(score) AS liked FROM s WHERE train GROUP BY user, item),
tastes AS (SELECT user, term, sum(liked * weight) AS taste FROM liked JOIN weights USING (item) GROUP BY user, term),
lengths AS (SELECT user, sqrt(sum(taste * taste)) AS length FROM tastes GROUP BY user),
pairs AS (SELECT DISTINCT user, item, prediction FROM predictions),
dots AS (SELECT user, item, sum(taste * weight) AS dot FROM pairs JOIN weights USING (item) JOIN tastes USING (user, term) GROUP BY user, item),
b AS (SELECT min(prediction) AS lo, max(prediction) AS hi FROM pairs)
SELECT user, item, round(coalesce(dot / length, 0), 6) AS content,
  round(0.7 * (prediction - lo) / (hi - lo) + 0.3 * coalesce(dot / length, 0), 6) AS score
FROM pairs LEFT JOIN dots USING (user, item) LEFT JOIN lengths USING (user), b
""")
def hybrid_score_mean_model(spark, folder):
    train, _ = _split(spark, folder)
    pairs = _mean_predictions(spark, folder).select("user", "item", "prediction").distinct()
    weights = _item_weights(spark, folder)
    profiles = hybrid.user_profiles(train, weights, "user", "item", "score")
    contents = hybrid.content_scores(pairs, profiles, weights, "user", "item")
    scores = hybrid.hybrid_scores(pairs, contents, "user", "item")
    return rounded(scores, 6, "content", "score").select("user", "item", "content", "score")


def _ratings(spark, folder):
    """Ratings with dense ids of users and items, written once as the fit reads them in every iteration."""
    narrow = materialise(reviews(spark, folder).select("user", "item", "name", "score", "ordr", "nights"))
    rows = collab.with_index(collab.with_index(narrow, "user", "user_id"), "item", "item_id")
    kept = collab.clean_ratings(rows, "user_id", "item_id", "score").withColumn("whole", F.col("score").cast("int"))
    return materialise(kept.select("user", "user_id", "item", "item_id", "name", "score", "ordr", "nights", "whole"))


def _split_ratings(spark, folder):
    return collab.hash_split(_ratings(spark, folder), ["ordr", "item", "nights", "whole"])


def _fit(train):
    return collab.fit_als(train, "user_id", "item_id", "score")


@ENTRIES.add()
def als_predict(spark, folder):
    train, test = _split_ratings(spark, folder)
    predictions = collab.predict(_fit(train), test)
    return predictions.select("user_id", "item_id", "score", "prediction")


@ENTRIES.add()
def als_rmse(spark, folder):
    train, test = _split_ratings(spark, folder)
    return stats.rmse(collab.predict(_fit(train), test), "score", "prediction")


@ENTRIES.add()
def als_recommend_user(spark, folder):
    ratings = _ratings(spark, folder)
    return collab.recommend_for_user(_fit(ratings), ratings.select("item_id", "name"), 1, 10, ["name"])


@ENTRIES.add()
def als_recommend_all(spark, folder):
    ratings = _ratings(spark, folder)
    names = ratings.select("item_id", F.col("name").alias("p_name")).distinct()
    return collab.recommend_for_users(_fit(ratings), 10, items=names)


@ENTRIES.add()
def als_model_roundtrip(spark, folder):
    path = shared_folder(spark)
    collab.save_model(_fit(_ratings(spark, folder)), path)
    return collab.load_model(path).itemFactors


@ENTRIES.add()
def hybrid_score(spark, folder):
    train, test = _split_ratings(spark, folder)
    predictions = materialise(collab.predict(_fit(train), test).groupBy("user_id", "item_id").agg(F.first("prediction").alias("prediction")))
    ids = train.unionByName(test).select("item", "item_id").distinct()
    weights = _item_weights(spark, folder).join(ids, "item").select("item_id", "term", "weight")
    profiles = hybrid.user_profiles(train, weights, "user_id", "item_id", "score")
    contents = hybrid.content_scores(predictions, profiles, weights, "user_id", "item_id")
    return hybrid.hybrid_scores(predictions, contents, "user_id", "item_id")


@ENTRIES.add()
def hybrid_vectors(spark, folder):
    train, test = _split_ratings(spark, folder)
    vectors = hybrid.item_text_vectors(_item_texts(spark, folder), "item", "text")
    return hybrid.hybrid_join(collab.predict(_fit(train), test), vectors, "item").select("user_id", "item_id", "score", "prediction", "tfidf_features")


@ENTRIES.add()
def mllib_text_features(spark, folder):
    documents = texts(spark, folder, "doc_id", "text")
    _, made = features.hashed_text_features(documents, "text")
    return made.select("doc_id", "tfidf_features")


_WORDS_SQL = r"string_split_regex(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+$', ''), '[ \t\n\x0B\f\r]')"


@ENTRIES.add(f"""
SELECT doc_id, CAST(len(list_filter({_WORDS_SQL}, lambda w: w NOT IN ({quoted(LANGUAGE_WORDS['en'])}))) AS BIGINT) AS tokens, 2000 AS size
FROM documents
""")
def mllib_text_facts(spark, folder):
    """Per document the number of tokens that the hashed counts add up to, and the length of the vector."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    _, made = features.hashed_text_features(documents, "text", stop_words=LANGUAGE_WORDS["en"])
    counts = vector_to_array("rawFeatures")
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return made.select("doc_id", total.cast("long").alias("tokens"), F.size(counts).alias("size"))


# What SQL can say about the factor model: which rows it scores, and whether its numbers fit together.
def _dot(model, rows):
    """``rows`` with the product of the stored factors of their user and item."""
    user = model.userFactors.select(F.col("id").alias("user_id"), F.col("features").alias("u"))
    item = model.itemFactors.select(F.col("id").alias("item_id"), F.col("features").alias("v"))
    product = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return rows.join(user, "user_id").join(item, "item_id").withColumn("dot", product)


_TRAIN_SQL = f"{REVIEWS_SQL}, s AS (SELECT *, {_MARK_SQL} AS train FROM reviews)"


@ENTRIES.add(f"""
WITH {_TRAIN_SQL} SELECT user, count(*) AS scored, true AS product FROM s
WHERE NOT train AND item IN (SELECT item FROM s WHERE train) AND user IN (SELECT user FROM s WHERE train) GROUP BY user
""")
def als_predict_facts(spark, folder):
    """Per user: held-out rows with a score, and whether each is the product of the stored factors."""
    train, test = _split_ratings(spark, folder)
    model = _fit(train)
    found = _dot(model, collab.predict(model, test)).withColumn("near", F.abs(F.col("dot") - F.col("prediction")) < 1e-3)
    return found.groupBy("user").agg(F.count("*").alias("scored"), F.bool_and("near").alias("product"))


@ENTRIES.add(f"WITH {REVIEWS_SQL} SELECT user, 10 AS rows, true AS best FROM reviews GROUP BY user")
def als_recommend_facts(spark, folder):
    """Per user: how many items are recommended, and whether no other item that the user rated has a higher score."""
    ratings = _ratings(spark, folder)
    model = _fit(ratings)
    top = collab.recommend_for_users(model, 10).select("user_id", "item_id", F.col("rank").alias("place"))
    names = ratings.select("user_id", "user").distinct()
    pairs = ratings.select("user_id", "item_id").union(top.select("user_id", "item_id")).distinct().join(names, "user_id")
    scored = _dot(model, pairs).join(top, ["user_id", "item_id"], "left")
    listed = F.col("place").isNotNull()
    return scored.groupBy("user").agg(
        F.count_if(listed).cast("int").alias("rows"),
        F.coalesce(F.min(F.when(listed, F.col("dot"))) >= F.max(F.when(~listed, F.col("dot"))) - 1e-3, F.lit(True)).alias("best"))


@ENTRIES.add(f"WITH {REVIEWS_SQL} SELECT count(DISTINCT item) AS items, 20 AS rank, true AS same FROM reviews")
def als_model_facts(spark, folder):
    """The stored model: its items, the length of its factors, and whether it reads back as written."""
    path = shared_folder(spark)
    model = _fit(_ratings(spark, folder))
    collab.save_model(model, path)
    read = collab.load_model(path).itemFactors.select("id", F.col("features").alias("again"))
    both = model.itemFactors.join(read, "id", "full")
    same = F.coalesce(F.col("features") == F.col("again"), F.lit(False))
    return both.agg(F.count("*").alias("items"), F.max(F.size("again")).alias("rank"), F.bool_and(same).alias("same"))


@ENTRIES.add("SELECT true AS formula, true AS below_item_means")
def als_rmse_facts(spark, folder):
    """Whether the error is that of the formula, and on training rows below that of the items' means."""
    train, _ = _split_ratings(spark, folder)
    scored = materialise(collab.predict(_fit(train), train).select("item", "score", F.col("prediction").cast("double").alias("prediction")))
    error = collab.evaluate_rmse(scored, "score")
    gap = F.col("score") - F.col("prediction")
    means = scored.groupBy("item").agg(F.avg("score").alias("mean"))
    off = F.col("score") - F.col("mean")
    return scored.join(means, "item").agg(
        (F.abs(F.sqrt(F.avg(gap * gap)) - error) < 1e-6).alias("formula"), (F.avg(gap * gap) < F.avg(off * off)).alias("below_item_means"))


@ENTRIES.add(f"WITH {REVIEWS_SQL} SELECT count(*) AS rows, true AS complete, true AS disjoint, true AS about_four_fifths FROM reviews")
def random_split_facts(spark, folder):
    """The random split: together all rows, no row twice, and the wanted share."""
    rows = materialise(reviews(spark, folder).select(*KEY).withColumn("row", F.monotonically_increasing_id()))
    train, test = collab.random_split(rows)
    marked = train.select("row", F.lit(1).alias("t")).unionByName(test.select("row", F.lit(0).alias("t")))
    per_row = rows.select("row").join(marked.groupBy("row").agg(F.count("*").alias("n"), F.max("t").alias("t")), "row", "left")
    return per_row.agg(
        F.count("*").alias("rows"), F.bool_and(F.col("n").isNotNull()).alias("complete"), F.bool_and(F.coalesce("n", F.lit(1)) == 1).alias("disjoint"),
        (F.abs(F.avg("t") - 0.8) < 0.03).alias("about_four_fifths"))


# Every twentieth embedding as a user, all as items, of lengths that differ.


def _factors(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double") * (1 + F.col("vec_id") % 50), 4)).alias("features"))
    return rows.where("id % 20 = 0"), rows


@ENTRIES.add("""
WITH f AS (SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * (1 + vec_id % 50), 4)) AS v FROM embeddings),
s AS (SELECT u.id AS user, i.id AS item, round(list_inner_product(u.v, i.v), 6) AS score FROM f u JOIN f i ON u.id % 20 = 0)
SELECT user, item, score, CAST(row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""")
def factor_best_items(spark, folder):
    """The items with the largest products for every user, by buckets of falling length."""
    users, items = _factors(spark, folder)
    return rounded(factors.best_items(users, items, 10, bucket=64), 6, "score")


@ENTRIES.add()
def als_best_items(spark, folder):
    """The best items of all users by the stored factors."""
    model = _fit(_ratings(spark, folder))
    return factors.best_items(model.userFactors, model.itemFactors, 10)


# Parts described by two numbers, so that SQL can solve the equations by Cramer's rule.
@ENTRIES.add(f"""
WITH {REVIEWS_SQL},
f AS (SELECT p_partkey AS item, p_size / 50.0 AS a, p_retailprice / 2000.0 AS b FROM part),
s AS (SELECT user, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * score) AS ra, sum(b * score) AS rb
  FROM reviews JOIN f USING (item) GROUP BY user),
m AS (SELECT user, aa + 0.1 * n AS aa, ab, bb + 0.1 * n AS bb, ra, rb FROM s)
SELECT user, round((ra * bb - rb * ab) / (aa * bb - ab * ab), 6) AS first, round((aa * rb - ab * ra) / (aa * bb - ab * ab), 6) AS second FROM m
""")
def fold_in_factors(spark, folder):
    """Factors of users by their ratings of parts with known factors."""
    rows = reviews(spark, folder).select("user", "item", "score").withColumn("user_id", F.regexp_extract("user", r"(\d+)$", 1).cast("long"))
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice").cast("double") / 2000.0).alias("features"))
    found = factors.fold_in_users(rows, parts, "user_id", "item", "score", 0.1)
    names = rows.select(F.col("user_id").alias("id"), "user").distinct()
    made = found.join(names, "id").select("user", F.col("features")[0].alias("first"), F.col("features")[1].alias("second"))
    return rounded(made, 6, "first", "second")
