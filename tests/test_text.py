from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.functions import text as ft
from reviewlens.operators import features, text
from reviewlens.sources import words as sources


def test_has_letter(column):
    assert column(ft.has_letter, ["abc", "12 !?", "Привет", "×", "漢字", "👍", None, "ệ"]) == [
        True, False, True, True, False, False, False, True]


def test_drop_words(column):
    out = column(lambda c: ft.drop_words(c, ["Bad", "bad"], ["the", "very_good"]), ["The  room was BAD ", "very_good", None, " "])
    assert out == ["room was", "", None, ""]
    assert column(lambda c: ft.drop_words(c), ["  a \t b "]) == ["a b"]


def test_drop_words_is_idempotent(column):
    once = column(lambda c: ft.drop_words(c, ["x"]), ["a x b", " x X  y"])
    assert column(lambda c: ft.drop_words(c, ["x"]), once) == once


def in_order(text_, pairs):
    for key, value in pairs:
        if value:
            text_ = text_.replace(key, value)
    return text_


@pytest.mark.parametrize("pairs", [
    [("z", "rồi"), ("cũng z", "never")], [("a", "b"), ("b", "c"), ("aa", "x")], [("ks", ""), ("k", "không")],
])
def test_replace_substrings_is_sequential(column, pairs):
    texts = ["cũng zz aab ks k", "banana", ""]
    assert column(lambda c: ft.replace_substrings(c, ft.dictionary_column(pairs)), texts) == [in_order(t, pairs) for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=2), st.text("abcd", max_size=2)), min_size=1, max_size=6),
       st.lists(st.text("abcd ", max_size=12), min_size=1, max_size=4))
def test_replace_substrings_like_plain_loop(column, pairs, texts):
    if not any(v for _, v in pairs):
        return
    assert column(lambda c: ft.replace_substrings(c, ft.dictionary_column(pairs)), texts) == [in_order(t, pairs) for t in texts]


def test_replace_tokens(column):
    assert column(lambda c: ft.replace_tokens(c, [("k", "không"), ("x", "")]), ["k ok  kk x", None]) == ["không ok kk x", None]


def test_tokens(column):
    assert column(ft.terms, ["Xin CHÀO, a room_type: 42!"]) == [["xin", "chào", "room_type", "42"]]
    assert column(ft.stripped_tokens(["the"]), ["The_room, the (pool)!"]) == [["The", "room", "pool"]]
    assert column(ft.cloud_words, ["Hotel's staff don't 24 b2 1990's"]) == [["hotel", "staff", "don't", "b2"]]


def test_language_vote_ties_and_unknown(column):
    words = {"xx": ["aa", "shared"], "bb": ["cc", "shared"]}
    vote = lambda c: ft.language_vote(c, words)
    assert column(vote, ["aa aa cc", "shared", "cc", "none here", None, ""]) == ["xx", "bb", "bb", None, None, None]


def test_language_filter_keeps_unknown(spark):
    df = spark.createDataFrame([(1, "the room and the pool"), (2, "der und die das"), (3, "?!"), (4, None)], "i int, t string")
    assert sorted(r.i for r in text.keep_languages(df, "t", ["vi", "en"]).collect()) == [1, 3, 4]
    assert text.flag_languages(df, "t", ["vi", "en"], "other").agg(F.count_if("other")).first()[0] == 1


@pytest.mark.parametrize("part_rows", [1, 2, 100])
def test_concat_by_group_parts_join_to_the_whole(spark, part_rows):
    rows = [(g, i, f"{g}{i}") for g in "ab" for i in range(7)] + [("a", 99, None), (None, 1, "x")]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(5)
    parts = text.concat_by_group(df, "g", "t", ["i"], part_rows).orderBy("g", "part").collect()
    for g in "ab":
        assert " ".join(r.t for r in parts if r.g == g) == " ".join(f"{g}{i}" for i in range(7))
    assert all(len(r.t.split()) <= part_rows for r in parts)


def test_word_frequencies_merge_plurals(spark):
    df = spark.createDataFrame([("rooms room class glass bus s",), ("Rooms the pools",)], "t string")
    rows = {r.word: (r.n, r.weight) for r in text.word_frequencies(df, "t", ["the"]).collect()}
    assert rows == {"room": (3, 1.0), "class": (1, 1 / 3), "glass": (1, 1 / 3), "bus": (1, 1 / 3), "s": (1, 1 / 3), "pools": (1, 1 / 3)}


def test_remove_listed_words_equals_in_row_removal(spark):
    df = spark.createDataFrame([(1, "The good  bad one"), (2, None), (3, "bad"), (4, "")], "i int, t string")
    listed = spark.createDataFrame([("bad",), ("the",)], "word string")
    found = {r.i: r.t for r in text.remove_listed_words(df, ["i"], "t", listed).collect()}
    assert found == {r.i: r.t for r in df.withColumn("t", ft.drop_words(F.col("t"), ["bad", "the"])).collect()}


def test_removal_of_many_words_looks_each_up_once(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(1, " ".join([*words, "Kept", *words]))], "i int, t string")
    made = text.remove_listed_words(df, ["i"], "t", spark.createDataFrame([(w,) for w in words], "word string"))
    assert made.first().t == "Kept" and "array_contains" not in made._jdf.queryExecution().toString()


def test_word_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("một_hai\n\n  và \nvà\n", encoding="utf-8")
    assert features.word_list(sources.read_words(spark, str(tmp_path / "w.txt"))) == ["một_hai", "và"]
    with pytest.raises(ValueError):
        features.word_list(sources.read_words(spark, str(tmp_path / "w.txt")), max_rows=1)
    (tmp_path / "d.txt").write_text("ko\tkhông\nzô\tvào\nno tab\nks\tkhách sạn\nzô\tvô\n\tlost\nempty\t\n", encoding="utf-8")
    read = sources.read_dictionary(spark, str(tmp_path / "d.txt"))
    pairs = features.dictionary_pairs(read)
    assert [p for p in pairs if p[1]] == [("ko", "không"), ("zô", "vô"), ("ks", "khách sạn")]


def test_merge_dictionaries(spark):
    a = spark.createDataFrame([(0, "x", "1"), (1, "y", "2"), (2, "x", "3")], "ord int, key string, value string")
    b = spark.createDataFrame([(0, "z", "4"), (1, "y", "5")], "ord int, key string, value string")
    merged = features.merge_dictionaries([a, b])
    assert features.dictionary_pairs(merged) == [("x", "3"), ("y", "5"), ("z", "4")]
