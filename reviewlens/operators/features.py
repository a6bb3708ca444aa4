"""Documents, term counts and TF-IDF weights as tables.

A document is a row of a documents table with a ``doc`` column; its terms are rows
``(doc, term, tf)``. No text of a whole entity and no term matrix is ever built: term counts of a
document are the sum of the counts of its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.functions.marks import MODULI, moved_marks, text_marks
from reviewlens.functions.text import Tokeniser, counted, terms
from reviewlens.operators.dedup import keep_first
from reviewlens.operators.joins import corpus_rows
from reviewlens.plans.positions import with_position, with_running_total
from reviewlens.plans.sizing import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, join_lookup, materialise


def term_counts(
    df: DataFrame, key: Sequence[str], texts: Sequence[str], tokenise: Tokeniser = terms, unique: bool = False
) -> DataFrame:
    """Bag of words ``(key.., term, tf)`` of one or more text columns, summed over rows of equal key.

    ``unique`` says that the key identifies a row; the counts are then taken inside each row and
    nothing is shuffled.
    """
    lists = [F.coalesce(tokenise(F.col(c)), F.array().cast("array<string>")) for c in texts]
    tokens = lists[0] if len(lists) == 1 else F.flatten(F.array(*lists))
    if unique:
        return df.select(*key, F.inline(counted(tokens)))
    exploded = df.select(*key, F.explode(tokens).alias("term"))
    return exploded.groupBy(*key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Dictionary ``(term, df, cf)``: documents holding the term, and occurrences in all of them."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def documents_per_entity(
    reviews: DataFrame, entities: DataFrame, *, entity: str, variant: str | None, body: str,
    attributes: Sequence[str], text_attributes: Sequence[str], order_by: Sequence[str], dedup: bool = True,
) -> DataFrame:
    """Documents ``(doc, entity, variant, attributes..)``, one per entity and variant in the reviews.

    The content of a document is all review bodies of the entity in ``order_by``, then the
    ``text_attributes`` (which may include the variant), joined by spaces. Documents with equal
    content are reduced to the first. ``doc`` is the position in (entity, variant) order.
    """
    rows = corpus_rows(reviews, entities, entity, variant, attributes)
    keys = [entity] if variant is None else [entity, variant]
    if dedup:
        marks = content_marks(reviews, rows, entity=entity, body=body, texts=text_attributes, order_by=order_by)
        rows = keep_first(marks, [*_MARKS, "__bytes"], keys).drop(*_MARKS, "__bytes")
    return with_position(rows, [F.col(c).asc_nulls_first() for c in keys], "doc")


_MARKS = [f"__mark_{i}" for i in range(len(MODULI))]


def content_marks(
    reviews: DataFrame, rows: DataFrame, *, entity: str, body: str, texts: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Add a 124-bit fingerprint of each document's content to ``rows``.

    A body's mark is taken in its row; moving it behind the bytes ahead of it is a product, and a document's mark is the sum of
    its bodies'. Only numbers are shuffled, no text.
    """
    # Every body takes the space behind it along.
    spaced = F.concat(F.col(body), F.lit(" "))
    bodies = reviews.filter(F.col(entity).isNotNull() & F.col(body).isNotNull()).select(
        entity, F.octet_length(spaced).cast("long").alias("__size"), text_marks(spaced).alias("__prints"),
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)],
    )
    order = [F.col(f"__o{i}").asc() for i in range(len(order_by))]
    placed = with_running_total(bodies, order, "__end", [entity], F.col("__size"))
    shifted = placed.withColumn("__prints", moved_marks(F.col("__prints"), F.col("__end") - F.col("__size")))
    per_entity = shifted.groupBy(entity).agg(
        *[(F.sum(F.col("__prints")[i]) % p).alias(f"__body_{i}") for i, (p, _) in enumerate(MODULI)], F.max("__end").alias("__body_bytes"),
    )
    joined = join_lookup(rows, per_entity, [entity], "left", derived=True)
    # An entity without any body contributes an empty one.
    first = F.coalesce(F.col("__body_bytes"), F.lit(1).cast("long"))
    rest = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts])
    out = joined.withColumn("__first", first).withColumn("__rest", moved_marks(text_marks(rest), F.col("__first"))).withColumn("__bytes", F.col("__first") + F.octet_length(rest))
    for i, (p, _) in enumerate(MODULI):
        # The mark of a single space is its coefficient.
        out = out.withColumn(_MARKS[i], (F.coalesce(F.col(f"__body_{i}"), F.lit(33).cast("long")) + F.col("__rest")[i]) % p)
    return out.drop("__rest", "__first", "__body_bytes", *[f"__body_{i}" for i in range(len(MODULI))])


def entity_term_counts(
    reviews: DataFrame, documents: DataFrame, *, entity: str, body: str, text_attributes: Sequence[str],
    tokenise: Tokeniser = terms,
) -> DataFrame:
    """Bag of words ``(doc, term, tf)`` of :func:`documents_per_entity` documents.

    Body counts are taken once per entity (partial sums ahead of the shuffle) and then handed to
    the entity's documents; attribute words are added to them.
    """
    bodies = term_counts(reviews.filter(F.col(entity).isNotNull()), [entity], [body], tokenise)
    owners = documents.select(entity, "doc")
    handed = join_lookup(bodies, owners, [entity], "inner").select("doc", "term", "tf")
    attributes = term_counts(documents, ["doc"], text_attributes, tokenise)
    return handed.unionByName(attributes).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


def _smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _log2_idf(n: Column, df: Column) -> Column:
    return F.log2(n / df)


IDF_FORMULAS = {"smooth": _smooth_idf, "log2": _log2_idf}


def tfidf(
    counts: DataFrame, documents: DataFrame, scheme: str = "smooth", max_rows: int = BROADCAST_ROWS, stored: bool = False
) -> DataFrame:
    """Weights ``(doc, term, weight)`` of unit length per document.

    ``smooth`` is ``tf * (ln((1 + n) / (1 + df)) + 1)``; ``log2`` is ``tf * log2(n / df)``, where
    terms in every document vanish. ``n`` counts ``documents``, empty ones too. ``stored`` says that ``counts`` is a
    stored table, of which no copy is made.
    """
    formula = IDF_FORMULAS[scheme]
    counts = counts if stored else materialise(counts)
    total = documents.agg(F.count("*").alias("n"))
    idf = materialise(counts.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", "df", formula(total.scalar(), F.col("df")).alias("idf")
    ))
    raw = (
        _with_idf(counts, idf, max_rows)
        .select("doc", "term", (F.col("tf") * F.col("idf")).alias("raw")).filter(F.col("raw") > 0)
    )
    if documents.limit(max_rows + 1).count() > max_rows:
        # One shuffle by document, for its length and its weights.
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("doc")))
        return raw.filter(F.col("doc").isNotNull()).select("doc", "term", (F.col("raw") / norm).alias("weight"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    weighted = join_lookup(raw, norms, ["doc"], "inner", max_rows, derived=True)
    return weighted.select("doc", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def _with_idf(counts: DataFrame, idf: DataFrame, max_rows: int) -> DataFrame:
    """Counts with the ``idf`` of their term.

    Of a vocabulary that is too long to broadcast the most frequent terms are, which make most of the counts; only the counts of
    the others are shuffled.
    """
    if fits_broadcast(idf, max_rows):
        return counts.join(F.broadcast(idf.select("term", "idf")), "term")
    # Different numbers of documents: at most about the square root of twice the counts.
    least, room = None, max_rows
    for r in idf.groupBy("df").agg(F.count("*").alias("n"), F.sum(F.octet_length("term") + 16).alias("size")).orderBy(F.desc("df")).collect():
        room -= max(r["n"], r["size"] * max_rows // BROADCAST_BYTES)
        if room < 0:
            break
        least = r["df"]
    if least is None:
        return counts.join(idf.select("term", "idf"), "term")
    common, others = idf.where(F.col("df") >= least), idf.where(F.col("df") < least).select("term", "idf")
    columns = [*counts.columns, "idf"]
    near = counts.join(F.broadcast(common.select("term", "idf")), "term").select(*columns)
    far = counts.join(F.broadcast(common.select("term")), "term", "left_anti").join(others, "term").select(*columns)
    return near.unionByName(far)


def hashed_text_pipeline(
    text: str = "text", features: int = 2000, stop_words: Sequence[str] | None = None, pattern: str | None = None
) -> Pipeline:
    """MLlib stages: lower-case split, stop words, hashed counts, inverse document frequency.

    ``pattern`` switches from splitting at every white-space character to a regular expression.
    """
    splitter = (
        RegexTokenizer(inputCol=text, outputCol="words", pattern=pattern) if pattern
        else Tokenizer(inputCol=text, outputCol="words")
    )
    remover = StopWordsRemover(inputCol="words", outputCol="filtered")
    if stop_words is not None:
        remover = remover.setStopWords(list(stop_words))
    hashing = HashingTF(inputCol="filtered", outputCol="rawFeatures", numFeatures=features)
    idf = IDF(inputCol="rawFeatures", outputCol="tfidf_features")
    return Pipeline(stages=[splitter, remover, hashing, idf])


def hashed_text_features(df: DataFrame, text: str = "text", **options) -> tuple[PipelineModel, DataFrame]:
    """Fit the pipeline once; the model and the table with its feature columns.

    Texts are split and hashed once: the document frequencies and the features come from the stored counts.
    """
    *ahead, idf = hashed_text_pipeline(text, **options).getStages()
    model = PipelineModel(stages=ahead)
    hashed = materialise(model.transform(df))
    weighting = idf.fit(hashed.select(idf.getInputCol()))
    return PipelineModel(stages=[*ahead, weighting]), weighting.transform(hashed)


def merge_dictionaries(dictionaries: Sequence[DataFrame]) -> DataFrame:
    """Merge ``(ord, key, value)`` tables: a key keeps its first place and takes its last value."""
    ranked = [d.select(F.lit(i).alias("source"), "ord", "key", "value") for i, d in enumerate(dictionaries)]
    stacked = ranked[0]
    for table in ranked[1:]:
        stacked = stacked.unionByName(table)
    place = F.struct("source", "ord")
    merged = stacked.groupBy("key").agg(F.min(place).alias("first"), F.max_by("value", place).alias("value"))
    return with_position(merged, [F.col("first.source").asc(), F.col("first.ord").asc()], "ord").select("ord", "key", "value")


def dictionary_pairs(dictionary: DataFrame, max_rows: int = 20_000) -> list[tuple[str, str]]:
    """A dictionary table as ordered pairs for use in an expression; too long a table is an error."""
    rows = dictionary.orderBy("ord").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"dictionary has more than {max_rows} entries")
    return [(r["key"], r["value"]) for r in rows]


def word_list(words: DataFrame, column: str = "word", max_rows: int = 20_000) -> list[str]:
    """A word table as a sorted list; too long a table is an error (join it instead)."""
    rows = words.select(column).distinct().orderBy(column).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"word list has more than {max_rows} entries")
    return [r[column] for r in rows]
