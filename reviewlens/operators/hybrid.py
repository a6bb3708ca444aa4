"""Collaborative and content signals side by side, and blended into one score."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, StopWordsRemover, Tokenizer
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import BROADCAST_ROWS, fits_broadcast, join_lookup, materialise

# Fixed value: share of the collaborative score in the blend.
ALPHA = 0.7


def item_text_vectors(df: DataFrame, item: str, text: str, features: int = 2000) -> DataFrame:
    """One hashed TF-IDF vector per item, ``(item, tfidf_features)``, from all its texts.

    Hashed counts are summed per item with partial sums, which equals hashing the joined texts.
    """
    words = Tokenizer(inputCol=text, outputCol="__words").transform(df.select(item, text).filter(F.col(text).isNotNull()))
    kept = StopWordsRemover(inputCol="__words", outputCol="__kept").transform(words)
    hashed = HashingTF(inputCol="__kept", outputCol="__tf", numFeatures=features).transform(kept)
    per_item = materialise(hashed.groupBy(item).agg(Summarizer.sum(F.col("__tf")).alias("__tf")))
    model = IDF(inputCol="__tf", outputCol="tfidf_features").fit(per_item)
    return model.transform(per_item).select(item, "tfidf_features")


def hybrid_join(predictions: DataFrame, contents: DataFrame, item: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Predictions with the content row of their item; items without one keep nulls.

    ``contents`` must have one row per item: joining one row per review would repeat every
    prediction once for each review of the item.
    """
    if fits_broadcast(contents, max_rows):
        return predictions.join(F.broadcast(contents), item, "left")
    # Vectors of mostly zeros shuffle as few bytes, by which adaptive execution would broadcast them.
    return predictions.join(contents.hint("merge"), item, "left")


def user_profiles(ratings: DataFrame, weights: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """Taste of each user over terms: item weights times ratings, summed."""
    # Repeated (user, item) pairs collapse before the terms fan out.
    liked = ratings.groupBy(user, item).agg(F.sum(F.col(rating).cast("double")).alias("__liked"))
    terms = liked.join(weights, item)
    return terms.groupBy(user, "term").agg(F.sum(F.col("__liked") * F.col("weight")).alias("taste"))


def content_scores(
    pairs: DataFrame, profiles: DataFrame, weights: DataFrame, user: str, item: str
) -> DataFrame:
    """Cosine of the user's taste and the item's weights for the given pairs, 0 without shared terms.

    ``weights`` is ``(item, term, weight)`` of unit length per item. Only the given pairs are scored.
    """
    wanted = pairs.select(user, item).distinct()
    lengths = profiles.groupBy(user).agg(F.sqrt(F.sum(F.col("taste") * F.col("taste"))).alias("__length"))
    shared = join_lookup(wanted, weights, [item], "inner").join(profiles, [user, "term"])
    dots = shared.groupBy(user, item).agg(F.sum(F.col("taste") * F.col("weight")).alias("__dot"))
    joined = join_lookup(wanted.join(dots, [user, item], "left"), lengths, [user], "left")
    cosine = F.when(F.col("__length") > 0, F.col("__dot") / F.col("__length"))
    return joined.select(user, item, F.coalesce(cosine, F.lit(0.0)).alias("content"))


def hybrid_scores(
    predictions: DataFrame, contents: DataFrame, user: str, item: str, alpha: float = ALPHA,
    prediction: str = "prediction",
) -> DataFrame:
    """``alpha`` times the prediction scaled to 0..1 plus ``1 - alpha`` times the content score."""
    value = F.col(prediction).cast("double")
    bounds = predictions.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("b")).scalar()
    joined = predictions.join(contents, [user, item], "left").withColumn("__b", bounds)
    spread = F.col("__b.high") - F.col("__b.low")
    scaled = F.when(spread > 0, (value - F.col("__b.low")) / spread).otherwise(F.lit(0.0))
    score = alpha * scaled + (1 - alpha) * F.coalesce(F.col("content"), F.lit(0.0))
    return joined.withColumn("score", score).drop("__b")
