from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens import hotel
from reviewlens.functions.text import dictionary_column
from reviewlens.operators import insight
from reviewlens.plans.jobs import clean_entities, clean_reviews
from reviewlens.sources import tables


@pytest.fixture(scope="module")
def hotels_raw(spark):
    rows = [
        ("1_1", "Mường Thanh (Old)", "4.5 sao trên 5", "Road", None, "8,5", " 9.0 ", "No information", "NA", "", "1.234,5", "1d", "12"),
        ("1_2", "MƯỜNG Grand", "No information", "Lane", "Fine", "6,5", "7", "8", "8", "8", "8", "8", None),
        ("1_3", None, "sao", "Way", "Poor", "7,5", "8", "8", "8", "8", "8", "8", "na"),
    ]
    return tables.local_table(spark, rows, tables.text_schema(hotel.ENTITY_COLUMNS))


@pytest.fixture(scope="module")
def reviews_raw(spark):
    stay = "Đã ở 3 đêm vào Tháng 7 năm 2023"
    rows = [
        ("1", "1_1", "r1", "An", None, "Solo", "Twin", stay, "Đã nhận xét vào 12 tháng 8 2023", "8,0", "The room was xấu k"),
        ("2", "1_1", "r2", "An", None, "Solo", "Twin", stay, "Đã nhận xét vào 12 tháng 8 2023", "10,0", "Again"),
        ("3", "1_1", "r3", "Bo", "VN", None, None, "??", None, "no information", "Fine"),
        ("4", "9_9", "r4", "Cy", "VN", "Pair", "Suite", stay, "31 tháng 2 2023", "6,0", "Orphan"),
        ("5", None, "r5", "Di", "VN", "Pair", "Suite", stay, None, "6,0", "Keyless"),
        ("6", "1_2", "r6", None, "VN", "Pair", "Suite", stay, None, "6,0", "Nameless"),
        ("7", "1_2", "r7", "Eb", "VN", "Pair", "Suite", stay, None, "6,0", None),
        ("8", "1_2", "r8", "Fe", "US", "Pair", "Suite", stay, "1 tháng 12 2023", "7,0", "Multi\nline \"quoted\", text"),
    ]
    return tables.local_table(spark, rows, tables.text_schema(hotel.REVIEW_COLUMNS))


@pytest.fixture(scope="module")
def cleaned(hotels_raw, reviews_raw):
    entities = clean_entities(hotels_raw)
    reviews = clean_reviews(reviews_raw, entities, [F.col("num").cast("int")], stop_words=["the", "was"])
    return entities, reviews


def test_clean_entities(cleaned, hotels_raw):
    rows = {r.Hotel_ID: r for r in cleaned[0].collect()}
    assert hotel.RANK_TEXT not in cleaned[0].columns
    first = rows["1_1"]
    assert (first.Hotel_Rank_Num, first.Total_Score, first.Location, first.Cleanliness, first.Service) == (4.5, 8.5, 9.0, 0.0, 0.0)
    assert (first.Value_for_money, first.Comfort_and_room_quality, first.Hotel_Description) == (0.0, 0.0, "-")
    assert rows["1_2"].comments_count is None and rows["1_2"].Hotel_Rank_Num == 0
    assert {r.Cleanliness for r in clean_entities(hotels_raw, fill=None).collect()} == {None, 8.0}


def test_clean_reviews(cleaned):
    rows = {r.Reviewer_Name: r for r in cleaned[1].collect()}
    assert set(rows) == {"An", "Bo", "Fe"}
    an = rows["An"]
    # The mean is taken before the repeated review goes.
    assert (an.Score, an.Mean_Reviewer_Score, an.Days, an.Month_Stay, an.Review_Date) == (8.0, 9.0, 3, 7, dt.date(2023, 8, 12))
    assert an.Body_clean == "room xấu k" and an.Review_ID_real == "1_1_An_nan_2023-08-12"
    assert rows["Bo"].Score is None and rows["Bo"].Days is None and rows["Bo"].Review_ID_real == "1_1_Bo_VN_NaT"
    assert not set(hotel.REVIEW_DROPPED) & set(cleaned[1].columns)


def test_dictionary_is_applied_only_on_request(cleaned, reviews_raw):
    pairs = dictionary_column([("k", "không")])
    def body(normalise):
        made = clean_reviews(reviews_raw, cleaned[0], ["num"], dictionary=pairs, normalise=normalise)
        return made.filter("Reviewer_Name = 'An'").first().Body_clean
    assert body(False).endswith(" k") and body(True).endswith(" không")


def test_strict_job_fails_on_a_bad_row(cleaned, reviews_raw):
    with pytest.raises(Exception, match="in row"):
        clean_reviews(reviews_raw, cleaned[0], ["num"], strict=True).collect()


def test_overview_and_strengths(cleaned):
    entities = cleaned[0]
    assert [r.Hotel_ID for r in insight.overview(entities, hotel.ID, hotel.NAME, hotel.OVERVIEW, keyword="(old)", literal=True).collect()] == ["1_1"]
    compared = insight.strengths_weaknesses(entities, hotel.ID, hotel.NAME, hotel.CRITERIA, keyword="mường")
    verdicts = {r.criteria: r.verdict for r in compared.collect()}
    assert verdicts["Total_Score"] == "strength" and verdicts["Cleanliness"] == "weakness" and len(verdicts) == 8
    lists = insight.strength_lists(compared, hotel.NAME, hotel.CRITERIA).first()
    assert lists.strengths == ["Hotel_Rank_Num", "Total_Score", "Location"] and "Service" in lists.weaknesses
    even = insight.strengths_weaknesses(entities, hotel.ID, hotel.NAME, ["Total_Score"], entity_id="1_3").first()
    assert even.value == even.average == 7.5 and even.verdict is None


def test_customer_statistics_and_bundle(cleaned):
    entities, reviews = cleaned
    made = insight.insight_bundle(
        entities, reviews, hotel.REVIEWS, id_col=hotel.ID, name_col=hotel.NAME, overview_columns=hotel.OVERVIEW,
        criteria=hotel.CRITERIA, entity_id="1_1", stop_words=["the"],
    )
    assert [tuple(r) for r in made["users"].collect()] == [("VN", 1)]
    assert [tuple(r) for r in made["trend"].collect()] == [(dt.date(2023, 8, 1), 1)]
    assert {r.Month_Stay: r.n for r in made["months"].collect()} == {**{m: 0 for m in range(1, 13)}, 7: 1}
    assert made["room_types"].first().share == 1.0 and made["mean_score"].first()[0] == 9.0
    assert sum(r.n for r in made["score_histogram"].collect()) == 1
    assert {r.word for r in made["words"].collect()} == {"room", "xấu", "k", "fine"}
    assert made["overview"].count() == 1


def test_report(cleaned):
    entities, reviews = cleaned
    joined = reviews.join(entities.drop(hotel.NAME), hotel.ID)
    report = insight.report_tables(joined, hotel.NAME, "Score", hotel.REPORT)
    assert tuple(report["totals"].first()) == (3, 2, 7.5)
    summary = {r["column"]: r for r in report["summary"].collect()}
    assert set(summary) == set(hotel.REPORT) and summary["Score"]["count"] == 2 and summary["Score"].std == 0.71


def test_files(spark, cleaned, reviews_raw, tmp_path):
    entities, reviews = cleaned
    tables.write_csv(reviews_raw, str(tmp_path / "raw"))
    again = tables.read_raw_csv(spark, str(tmp_path / "raw"), multiline=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, reviews_raw.collect()))
    tables.write_parquet(reviews, str(tmp_path / "p"), ["Nationality"])
    assert tables.read_clean(spark, str(tmp_path / "p")).count() == 3
    tables.write_csv(reviews.select("Review_ID_real", F.coalesce(F.col("Review_Date").cast("string"), F.lit("?")).alias("d")), str(tmp_path / "c"))
    dates = [r.d for r in tables.read_clean(spark, str(tmp_path / "c"), "csv", date_columns=["d"]).orderBy("Review_ID_real").collect()]
    assert dates == [dt.date(2023, 8, 12), None, dt.date(2023, 12, 1)]
    assert tables.spread(tables.read_clean(spark, str(tmp_path / "p"))).rdd.getNumPartitions() >= 8
