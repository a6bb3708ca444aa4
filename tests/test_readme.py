"""The README's example, run as it stands, and the features that no SQL covers."""

from __future__ import annotations

import csv
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens import hotel
from reviewlens.catalog import ENTRIES, collab as catalog
from reviewlens.functions import marks
from reviewlens.functions.text import LANGUAGE_WORDS
from reviewlens.operators import collab, factors, features
from reviewlens.sources.artefacts import load_artefacts

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
tabled = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_example(spark, tmp_path, monkeypatch):
    with open(os.path.join(HERE, "README.md"), encoding="utf-8") as file:
        example = re.search(r"```python\n(.*?)```", file.read(), re.DOTALL)[1]
    (tmp_path / "raw").mkdir()
    names = ["Da Nang Palace", "Da Nang Beach", "Hue Garden", "Sapa View"]
    hotels = [(f"1_{i}", n, "4 sao", "Road", f"a quiet place {i}", *["8,5"] * 7, "3") for i, n in enumerate(names)]
    stay, day = "Đã ở 3 đêm vào Tháng 7 năm 2023", "Đã nhận xét vào 12 tháng 8 2023"
    reviews = [(i, f"1_{i % 4}", f"r{i}", f"guest {i}", "VN", "Solo", "Twin", stay, day, "8,0", f"clean room\nnear beach {i % 3}") for i in range(24)]
    for name, columns, rows in (("hotels", hotel.ENTITY_COLUMNS, hotels), ("reviews", hotel.REVIEW_COLUMNS, reviews)):
        with open(tmp_path / "raw" / f"{name}.csv", "w", newline="", encoding="utf-8") as file:
            csv.writer(file).writerows([columns, *rows])
    monkeypatch.chdir(tmp_path)
    # Spark resolves paths by the folder its JVM was started in.
    made = {}
    exec(re.sub(r'"(raw|shared)/', rf'"{tmp_path}/\1/', example), made)
    assert load_artefacts(spark, f"{tmp_path}/shared/artefacts", ("profiles",))["profiles"].count() == 4
    top = made["found"].collect()
    assert {r["src"] for r in top} == {r["doc"] for r in made["documents"].where("Hotel_Name LIKE 'Da Nang%'").collect()}
    assert {r["rank"] for r in top} == {1, 2, 3}


def murmur(data: bytes, seed: int = 42) -> int:
    """Murmur3 of 32 bits, as the hashed counts use it."""
    mask, h = 0xFFFFFFFF, seed
    rotate = lambda x, n: ((x << n) | (x >> (32 - n))) & mask
    scramble = lambda k: rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h = (rotate(h ^ scramble(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@tabled
def test_hashed_features_as_plain_python(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(100)
    rows = df.collect()
    df = spark.createDataFrame(rows, df.schema)
    _, made = features.hashed_text_features(df, "text", stop_words=LANGUAGE_WORDS["en"])
    counts = {}
    for r in rows:
        words = re.split(r"[ \t\n\x0B\f\r]", r["text"].lower())
        while words and not words[-1]:
            words.pop()
        counts[r["doc_id"]] = Counter(murmur(w.encode()) % 2000 for w in words if w not in LANGUAGE_WORDS["en"])
    df_ = Counter(i for c in counts.values() for i in c)
    for r in made.select("doc_id", "rawFeatures", "tfidf_features").collect():
        want = counts[r["doc_id"]]
        assert dict(zip(r["rawFeatures"].indices.tolist(), r["rawFeatures"].values.tolist())) == want
        weights = dict(zip(r["tfidf_features"].indices.tolist(), r["tfidf_features"].values.tolist()))
        assert weights == pytest.approx({i: n * np.log((len(rows) + 1) / (df_[i] + 1)) for i, n in want.items()})


@tabled
def test_best_items_of_one_user(spark):
    """Of the trained model: the registered query, the factors' products, and Spark's own list agree."""
    ratings = catalog._ratings(spark, FOLDER)
    model = collab.fit_als(ratings, "user_id", "item_id", "score")
    names = {r["item_id"]: r["name"] for r in ratings.select("item_id", "name").distinct().collect()}
    one = collab.recommend_for_user(model, ratings.select("item_id", "name"), 1, 10, ["name"]).collect()
    exact = factors.best_items(model.userFactors.where("id = 1"), model.itemFactors, 10).orderBy("rank").collect()
    assert [r["prediction"] for r in one] == pytest.approx([r["score"] for r in exact], abs=1e-4)
    assert all(names[r["item_id"]] == r["name"] for r in one)
    whole = collab.recommend_for_users(model, 10).where("user_id = 1").orderBy("rank").collect()
    assert [r["prediction"] for r in whole] == pytest.approx([r["score"] for r in exact], abs=1e-4)


@tabled
def test_hybrid_scores_are_the_blend(spark):
    rows = ENTRIES["hybrid_score"].run(spark, FOLDER).collect()
    low, high = min(r["prediction"] for r in rows), max(r["prediction"] for r in rows)
    for r in rows:
        assert -1e-9 <= r["content"] <= 1 + 1e-9
        assert r["score"] == pytest.approx(0.7 * (r["prediction"] - low) / (high - low) + 0.3 * r["content"], abs=1e-5)


def test_marks_of_joined_texts(spark, monkeypatch):
    monkeypatch.setattr(marks, "CHUNK", 16)
    texts = ["", "a", "Đà Nẵng", "x" * 15, "y" * 16, "z" * 33, "long " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole, tail = "head of it " * 5, F.lit(len(("head of it " * 5).encode())).cast("long")
    made = df.select("t", marks.text_marks(F.concat(F.lit(whole), "t")).alias("joined"), marks.text_marks(F.lit(whole)).alias("head"),
                     marks.moved_marks(marks.text_marks(F.col("t")), tail).alias("tail")).collect()
    for r in made:
        plain = [sum((x + 1) * pow(base, j, p) for j, x in enumerate((whole + r["t"]).encode())) % p for p, base in marks.MODULI]
        assert r["joined"] == plain == [(a + b) % p for a, b, (p, _) in zip(r["head"], r["tail"], marks.MODULI)]
