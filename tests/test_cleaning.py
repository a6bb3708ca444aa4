from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import cleaning as fc
from reviewlens.operators import cleaning


def test_clean_token_strips_all_white_space_and_drops_dirty_spellings(column):
    values = ["  No Information\t", "NaN", " NULL　", "", " Na ", "None", "Good ", None]
    assert column(fc.clean_token, values) == [None, None, None, None, None, None, "good", None]


@pytest.mark.parametrize(("text", "number"), [
    ("8,5", 8.5), (" 9.0 ", 9.0), ("No information", None), ("NA", None), ("", None), ("1.234,5", None), ("1d", None),
    ("1f", None), (None, None), ("1e3", 1000.0), ("-,5", -0.5), ("0x1A", None), ("1_0", None), ("inf", None), ("5.", 5.0),
])
def test_clean_number(column, text, number):
    assert column(fc.clean_number, [text]) == [number]


def test_clean_number_is_idempotent(column):
    once = column(fc.clean_number, ["8,5", "NA", "7"])
    assert column(fc.clean_number, [None if v is None else str(v) for v in once]) == once


def test_strict_number_fails_on_bad_text(column):
    assert column(lambda c: fc.clean_number(c, strict=True), ["8,5", "na"]) == [8.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(lambda c: fc.clean_number(c, strict=True), ["eight"])


def test_first_number(column):
    assert column(fc.first_number, ["4.5 sao trên 5", "No information", "sao", None, "3 sao"]) == [4.5, None, None, None, 3.0]


def test_stay_details(column):
    text = ["Đã ở 3 đêm vào Tháng 7 năm 2023", "không rõ", None]
    assert column(lambda c: fc.extract_int(c, fc.NIGHTS_PATTERN), text) == [3, None, None]
    assert column(lambda c: fc.extract_int(c, fc.MONTH_PATTERN), text) == [7, None, None]
    with pytest.raises(Exception, match="no .* in row"):
        column(lambda c: fc.extract_int(c, fc.NIGHTS_PATTERN, strict=True), text)


def test_local_date(column):
    text = ["Đã nhận xét vào 12 tháng 8 2023", "31 tháng 2 2023", None, "sometime"]
    assert column(fc.local_date, text) == [dt.date(2023, 8, 12), None, None, None]
    with pytest.raises(Exception, match="impossible date"):
        column(lambda c: fc.local_date(c, strict=True), text)


def test_name_matches(column):
    names = ["Mường Thanh", "MƯỜNG THANH Grand", "Hotel (Old)", None, "Oasis+"]
    assert column(lambda c: fc.name_matches(c, "mường thanh"), names) == [True, True, False, False, False]
    assert column(lambda c: fc.name_matches(c, "(old)", literal=True), names) == [False, False, True, False, False]
    assert column(lambda c: fc.name_matches(c, "OASIS+", literal=True), names)[4]
    assert column(lambda c: fc.name_matches(c, ""), names) == [True, True, True, False, True]


def test_synthetic_key_keeps_missing_parts_comparable(spark):
    df = spark.createDataFrame([("1_1", "An", None, None), ("1_1", "An", "VN", dt.date(2023, 8, 1))], "h string, r string, n string, d date")
    key = fc.synthetic_key((F.col("h"), "nan"), (F.col("r"), "nan"), (F.col("n"), "nan"), (F.col("d"), "NaT"))
    assert [r[0] for r in df.select(key).collect()] == ["1_1_An_nan_NaT", "1_1_An_VN_2023-08-01"]


def test_headers_fill_drop(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a", None)], "` Hotel ID` int, `Stay Details` string, c string")
    clean = cleaning.normalise_headers(df)
    assert clean.columns == ["Hotel_ID", "Stay_Details", "c"]
    filled = cleaning.fill_nulls(clean, {"Hotel_ID": 0, "Stay_Details": "-"})
    assert sorted(map(tuple, filled.collect()), key=str) == [(0, "a", None), (1, "-", "x")]
    assert cleaning.drop_null_rows(clean, ["Hotel_ID", "c"]).count() == 1


def test_find_entities(spark):
    df = spark.createDataFrame([("1_1", "A"), ("1_2", "B"), ("1_3", None)], "id string, name string")
    assert [r.id for r in cleaning.find_entities(df, "id", "name", "b", "1_1").collect()] == ["1_1"]
    assert [r.id for r in cleaning.find_entities(df, "id", "name", "b").collect()] == ["1_2"]
    assert cleaning.find_entities(df, "id", "name", entity_id="9").count() == 0
    with pytest.raises(ValueError):
        cleaning.find_entities(df, "id", "name")


def test_dirty_token_scan_and_profile(spark):
    df = spark.createDataFrame([("NA ", "x", 1), (None, "y", 2), ("ok", "z", None)], "a string, b string, n int")
    assert [tuple(r) for r in cleaning.dirty_token_scan(df).collect()] == [("a", ["na", "nan"])]
    profile = [(r["column"], r["rows"], r["non_null"]) for r in cleaning.profile(df).collect()]
    assert sorted(profile) == [("a", 3, 2), ("b", 3, 3), ("n", 3, 2)]
