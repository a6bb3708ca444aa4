"""The language of a text by ranked character n-grams.

A language's profile is its ``most`` most frequent three-character pieces in labelled texts, ranked. A text is ranked in the same
way and belongs to the language whose ranks lie closest: the distance is the sum over the text's pieces of how far the ranks
are apart, a piece that a profile lacks counting ``most``. Everything is an expression over columns: pieces are
counted inside their row, joined to the profiles (a few hundred rows per language) and summed per text and language before
anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.functions.text import counted
from reviewlens.plans.sizing import materialise, small_side

SIZE = 3
MOST = 300


def grams(text: Column, size: int = SIZE) -> Column:
    """Pieces of ``size`` characters of the lower-case text, in which everything but letters is a single space."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    # A look-ahead finds a piece at every character; taking substrings by number would start over each time.
    return F.regexp_extract_all(plain, F.lit(f"(?=({'.' * size}))"), F.lit(1))


def learn_profiles(df: DataFrame, text: str, lang: str, most: int = MOST) -> DataFrame:
    """Profiles ``(lang, gram, rank)`` of the labelled rows; ties go to the smaller piece, ranks start at 0."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # A language has few different pieces: tasks count them in a hash table, without sorting a text's pieces.
    pieces = labelled.select(F.col(lang).alias("lang"), F.explode(grams(F.col(text))).alias("term"))
    totals = pieces.groupBy("lang", "term").agg(F.count("*").alias("n"))
    # Rows of a language are its different pieces, of which all but the first go ahead of the shuffle.
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))
    ranked = totals.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("term").alias("gram"), (F.col("rank") - 1).alias("rank"))


def nearest_language(df: DataFrame, key: Sequence[str], text: str, profiles: DataFrame, name: str = "lang", most: int = MOST) -> DataFrame:
    """``key`` and the language with the closest profile; ties go to the first name, null without a known piece.

    ``key`` must identify a row.
    """
    profiles = materialise(profiles)
    order = F.array_sort(F.transform(counted(grams(F.col(text))), lambda e: F.struct((-e["tf"]).alias("order"), e["term"].alias("gram"))))
    ranked = df.select(*key, F.posexplode(F.slice(order, 1, most)).alias("place", "e")).select(*key, "place", F.col("e.gram").alias("gram"))
    met = ranked.join(small_side(profiles), "gram")
    # A piece counts `most` where the profile lacks it: the sum is that for all pieces, less what the shared ones save.
    saved = met.groupBy(*key, "lang").agg(F.sum(F.lit(most) - F.abs(F.col("place") - F.col("rank"))).alias("saved"))
    best = saved.groupBy(*key).agg(F.min(F.struct((-F.col("saved")).alias("order"), "lang")).alias("b"))
    return df.select(*key).join(best, list(key), "left").select(*key, F.col("b.lang").alias(name))


def keep_languages_by_profile(df: DataFrame, key: Sequence[str], text: str, profiles: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows in one of the ``allowed`` languages or in none that can be told."""
    other = nearest_language(df, key, text, profiles, "__lang").where(~F.col("__lang").isin(*allowed)).select(*key)
    return df.join(other, list(key), "left_anti")
