"""Insight per entity: overview, strengths and weaknesses, customer statistics, word counts, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import stats
from reviewlens.operators.cleaning import find_entities, first_row
from reviewlens.operators.joins import against_average, zero_fill
from reviewlens.operators.text import word_frequencies


@dataclass(frozen=True)
class ReviewColumns:
    """Column names of a review table."""

    entity: str
    name: str
    user: str
    group: str
    date: str
    nights: str
    month: str
    room_type: str
    score: str
    mean_score: str
    body: str


def overview(
    entities: DataFrame, id_col: str, name_col: str, columns: Sequence[str], keyword: str | None = None,
    entity_id: object | None = None, literal: bool = False,
) -> DataFrame:
    """The chosen columns of the matching entities."""
    return find_entities(entities, id_col, name_col, keyword, entity_id, literal).select(*columns)


def strengths_weaknesses(
    entities: DataFrame, id_col: str, name_col: str, criteria: Sequence[str], keyword: str | None = None,
    entity_id: object | None = None, literal: bool = False, order_by: Sequence[str] | None = None,
) -> DataFrame:
    """First matching entity against the mean of all: ``(name, criteria, value, average, verdict)``.

    The verdict is ``strength`` above the mean, ``weakness`` below it and null on it.
    """
    matched = find_entities(entities, id_col, name_col, keyword, entity_id, literal)
    first = first_row(matched, order_by or [id_col])
    compared = against_average(first, entities, criteria, [name_col])
    verdict = F.when(F.col("value") > F.col("average"), "strength").when(F.col("value") < F.col("average"), "weakness")
    return compared.withColumn("verdict", verdict)


def strength_lists(compared: DataFrame, name_col: str, criteria: Sequence[str]) -> DataFrame:
    """One row ``(name, strengths, weaknesses)`` with the criteria in their given order."""
    place = F.array_position(F.array(*[F.lit(c) for c in criteria]), F.col("criteria"))

    def listed(verdict: str):
        # At most one entry per criterion.
        found = F.array_sort(F.collect_list(F.when(F.col("verdict") == verdict, F.struct(place.alias("p"), "criteria"))))
        return F.transform(found, lambda x: x["criteria"])

    return compared.groupBy(name_col).agg(listed("strength").alias("strengths"), listed("weakness").alias("weaknesses"))


def customer_statistics(
    reviews: DataFrame, columns: ReviewColumns, keyword: str | None = None, entity_id: object | None = None,
    literal: bool = False, top_users: int = 10, top_rooms: int = 5,
) -> dict[str, DataFrame]:
    """Named results over the reviews of the matching entities.

    Each is planned on its own and reads only the columns it needs. Pass a persisted table if most
    of them are wanted.
    """
    c = columns
    chosen = find_entities(reviews, c.entity, c.name, keyword, entity_id, literal)
    months = stats.frequencies(chosen, c.month)
    return {
        "users": stats.top_categories(chosen, c.user, top_users),
        "groups": stats.top_categories(chosen, c.group),
        "trend": stats.monthly_trend(chosen, c.date),
        "nights": stats.frequencies_in_key_order(chosen, c.nights),
        "months": zero_fill(months, c.month, "n", 1, 12),
        "room_types": stats.category_share(chosen, c.room_type, top_rooms),
        "score_histogram": stats.histogram_integer_edges(chosen, c.score, 0, 10),
        "mean_score": chosen.agg(F.avg(c.mean_score).alias("mean_score")),
    }


def word_cloud(
    reviews: DataFrame, columns: ReviewColumns, keyword: str | None = None, entity_id: object | None = None,
    literal: bool = False, stop_words: Sequence[str] = (), n: int = 200,
) -> DataFrame:
    """Word counts over the review texts of the matching entities."""
    chosen = find_entities(reviews, columns.entity, columns.name, keyword, entity_id, literal)
    return word_frequencies(chosen.filter(F.col(columns.body).isNotNull()), columns.body, stop_words, n)


def insight_bundle(
    entities: DataFrame, reviews: DataFrame, columns: ReviewColumns, *, id_col: str, name_col: str,
    overview_columns: Sequence[str], criteria: Sequence[str], keyword: str | None = None,
    entity_id: object | None = None, literal: bool = False, stop_words: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Overview, strengths and weaknesses, customer statistics and word counts by name."""
    match = {"keyword": keyword, "entity_id": entity_id, "literal": literal}
    return {
        "overview": overview(entities, id_col, name_col, overview_columns, **match),
        "strengths_weaknesses": strengths_weaknesses(entities, id_col, name_col, criteria, **match),
        **customer_statistics(reviews, columns, **match),
        "words": word_cloud(reviews, columns, stop_words=stop_words, **match),
    }


def long_form(results: Mapping[str, DataFrame]) -> DataFrame:
    """Stack results as ``(section, label, value)``: first column as label, second as value."""
    stacked = None
    for section, df in results.items():
        label, value = df.columns[0], df.columns[1]
        part = df.select(
            F.lit(section).alias("section"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def report_tables(
    joined: DataFrame, name_col: str, score: str, columns: Sequence[str]
) -> dict[str, DataFrame]:
    """Report data on reviews joined with entity scores: totals and the rounded summary."""
    return {
        "totals": stats.report_totals(joined, name_col, score),
        "summary": stats.describe(joined, columns, digits=2),
    }
