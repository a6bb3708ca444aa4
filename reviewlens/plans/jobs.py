"""The two cleaning jobs: raw hotel and review tables to clean ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import hotel
from reviewlens.functions.cleaning import (
    MONTH_PATTERN, NIGHTS_PATTERN, clean_number, clean_token, extract_int, first_number, local_date, synthetic_key,
)
from reviewlens.functions.text import drop_words, replace_substrings
from reviewlens.operators.cleaning import clean_numbers, drop_columns, drop_null_rows, normalise_headers
from reviewlens.operators.dedup import keep_first
from reviewlens.operators.joins import enrich
from reviewlens.operators.stats import mean_on_rows
from reviewlens.plans.audit import Audit

KEY = "Review_ID_real"


def clean_entities(raw: DataFrame, fill: float | None = 0.0, audit: Audit | None = None) -> DataFrame:
    """Numbers read, star rank extracted, missing scores and descriptions filled.

    ``fill=None`` keeps missing scores null, so that they do not pull means down. An ``audit`` counts dirty tokens and nulls.
    """
    if audit:
        raw = audit.watch(raw, "read", nulls=raw.columns, dirty=hotel.NUMBERS)
    read = clean_numbers(raw, hotel.NUMBERS).withColumn(hotel.RANK, first_number(clean_token(F.col(hotel.RANK_TEXT))))
    filled = read if fill is None else read.fillna({c: fill for c in hotel.CRITERIA})
    return drop_columns(filled.fillna({hotel.DESCRIPTION: "-"}), [hotel.RANK_TEXT])


def clean_reviews(
    raw: DataFrame, entities: DataFrame, order_by: Sequence[str | Column], *, stop_words: Sequence[str] = (),
    wrong_words: Sequence[str] = (), dictionary: Column | None = None, normalise: bool = False, strict: bool = False,
    audit: Audit | None = None,
) -> DataFrame:
    """Reviews with hotel name, stay, date, hotel mean and cleaned body; orphans and repeats removed.

    ``order_by`` says which of several equal reviews is first. The hotel mean is taken before
    orphans and repeats go. With ``normalise`` the ``dictionary`` is applied to the body before
    words are removed; by default it is not. An ``audit`` counts nulls and dirty tokens of the raw rows, and what goes
    for missing fields, as orphans and as repeats, while the result is written.
    """
    watch = audit.watch if audit else lambda df, *_, **__: df
    named = watch(normalise_headers(raw), "read", nulls=("Reviewer_Name", "Body", hotel.ID), dirty=("Score",))
    scored = named.withColumn("Score", clean_number(F.col("Score"), strict=strict))
    present = watch(drop_null_rows(scored, ["Reviewer_Name", "Body"]), "present", unscored=F.col("Score").isNull())
    # Watched rows would be read, counted and matched a second time for the means.
    unwatched = drop_null_rows(normalise_headers(raw).withColumn("Score", clean_number(F.col("Score"), strict=strict)), ["Reviewer_Name", "Body"]) if audit else None
    # Ahead of the name join: the means' own pass over the input reads three columns and joins nothing.
    averaged = mean_on_rows(present, hotel.ID, "Score", "Mean_Reviewer_Score", of=unwatched)
    joined = enrich(averaged, entities, hotel.ID, [hotel.NAME])
    dated = joined.withColumns({
        "Days": extract_int(F.col("Stay_Details"), NIGHTS_PATTERN, strict),
        "Month_Stay": extract_int(F.col("Stay_Details"), MONTH_PATTERN, strict),
        "Review_Date": local_date(F.col("Review_Date"), strict=strict),
    })
    known = watch(drop_null_rows(dated, [hotel.NAME]), "known", undated=F.col("Review_Date").isNull())
    key = synthetic_key(
        (F.col(hotel.ID), "nan"), (F.col("Reviewer_Name"), "nan"), (F.col("Nationality"), "nan"), (F.col("Review_Date"), "NaT")
    )
    unique = watch(keep_first(known.withColumn(KEY, key), [KEY], order_by), "unique")
    body = F.col("Body")
    if normalise and dictionary is not None:
        body = replace_substrings(body, dictionary)
    return drop_columns(unique.withColumn("Body_clean", drop_words(body, wrong_words, stop_words)), hotel.REVIEW_DROPPED)
