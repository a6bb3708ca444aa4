"""Text operators over tables: language filter, concatenation per group, word counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import Tokeniser, cloud_words, has_letter, language_vote, split_words
from reviewlens.plans.positions import with_position, with_running_total
from reviewlens.plans.sizing import small_side

# Bytes of one part of a group's text; a row may hold 2 GB.
PART_BYTES = 64 * 1024 * 1024


def flag_languages(
    df: DataFrame, text: str, allowed: Sequence[str], flag: str, lang: str | None = None,
    words: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Mark rows in a language other than ``allowed``; an unknown language is not marked.

    Uses the ``lang`` column if the table has one, else the stop-word vote over the text.
    """
    language = F.col(lang) if lang else language_vote(F.col(text), words)
    return df.withColumn(flag, F.coalesce(~language.isin(*allowed), F.lit(False)))


def keep_languages(
    df: DataFrame, text: str, allowed: Sequence[str], lang: str | None = None,
    words: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows in one of the ``allowed`` languages or in none that can be told."""
    return flag_languages(df, text, allowed, "__other", lang, words).filter(~F.col("__other")).drop("__other")


def keep_with_letters(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has a letter."""
    return df.filter(has_letter(F.col(text)))


def concat_by_group(
    df: DataFrame, group: str, text: str, order_by: Sequence[str], part_rows: int | None = None, sep: str = " ",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Texts of each group joined in order, as rows ``(group, part, text)``.

    Joining the parts in order gives the whole. A part takes the texts that begin within the same ``part_bytes``
    of the group's whole text, so it has at most those bytes and one text more, and a smaller group is one
    part; with ``part_rows`` it takes that many texts instead. A group that holds a large share of the table
    therefore never has to fit into one row or one task. Null texts are skipped.
    """
    kept = df.filter(F.col(group).isNotNull() & F.col(text).isNotNull()).select(
        group, F.col(text).alias("__text"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)]
    )
    order = [F.col(f"__o{i}").asc() for i in range(len(order_by))]
    if part_rows:
        placed = with_position(kept, order, "__pos", [group])
        pieces = placed.withColumn("part", F.floor(F.col("__pos") / part_rows).cast("int"))
    else:
        size = (F.octet_length("__text") + len(sep.encode())).cast("long")
        placed = with_running_total(kept, order, "__pos", [group], size)
        pieces = placed.withColumn("part", F.floor((F.col("__pos") - size) / part_bytes).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("__pos", "__text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["__text"]), sep)
    return pieces.groupBy(group, "part").agg(joined.alias(text))


def word_frequencies(
    df: DataFrame, text: str, stop_words: Sequence[str] = (), n: int = 200, merge_plurals: bool = True,
    tokenise: Tokeniser = cloud_words,
) -> DataFrame:
    """The ``n`` most frequent words of all texts: ``(word, n, weight)``, weight relative to the top word.

    With ``merge_plurals`` a word ending in a single ``s`` is counted under its form without it,
    where that form occurs too.
    """
    words = df.select(F.explode(tokenise(F.col(text))).alias("word")).filter(F.col("word") != "")
    if stop_words:
        words = words.filter(~F.col("word").isin(*stop_words))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    if merge_plurals:
        # A word falls under exactly one form, so one aggregation settles both counting and naming.
        plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss") & (F.length("word") > 1)
        form = F.when(plural, F.expr("substring(word, 1, length(word) - 1)")).otherwise(F.col("word"))
        merged = counts.withColumn("form", form).groupBy("form").agg(
            F.sum("n").alias("n"), F.max("word").alias("word"), F.bool_or(F.col("word") == F.col("form")).alias("own")
        )
        counts = merged.select(F.when(F.col("own"), F.col("form")).otherwise(F.col("word")).alias("word"), "n")
    top = counts.orderBy(F.desc("n"), "word").limit(n)
    return top.withColumn("weight", F.col("n") / top.agg(F.max("n")).scalar())


def remove_listed_words(
    df: DataFrame, key: Sequence[str], text: str, words: DataFrame, word_col: str = "word"
) -> DataFrame:
    """Remove the words of a table of any size from each text; ``key`` must identify a row.

    For lists that fit a driver constant use :func:`reviewlens.functions.text.drop_words`, which
    needs no shuffle.
    """
    lower = F.transform(split_words(F.col(text)), F.lower)
    tokens = df.select(*key, F.explode(F.array_distinct(lower)).alias("__word"))
    listed = small_side(words.select(F.col(word_col).alias("__word")).distinct())
    # Of the words only listed ones are gathered, each once per text.
    banned = tokens.join(listed, "__word").groupBy(*key).agg(F.collect_set("__word").alias("__banned"))
    joined = df.join(banned, list(key), "left")

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # A set per text: a word costs the same however many of the text's words are listed.
        for words_, lower_, banned_ in batches:
            out = []
            for plain, low, gone in zip(words_.to_pylist(), lower_.to_pylist(), banned_.to_pylist(), strict=True):
                gone = frozenset(gone or ())
                out.append(None if plain is None else " ".join(w for w, form in zip(plain, low, strict=True) if form not in gone))
            yield pa.array(out, pa.string())

    split = split_words(F.col(text))
    return joined.withColumn(text, kept(split, lower, F.col("__banned"))).drop("__banned")
