"""The stored index, nearest neighbours, long dictionaries and compound words, against plain Python."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.catalog import ENTRIES
from reviewlens.catalog.text import LONG_DICTIONARY
from reviewlens.functions import dictionary
from reviewlens.functions import text as ft
from reviewlens.operators import features, index, nearest, phrases, similar
from reviewlens.sources.artefacts import load_artefacts, save_artefacts
from reviewlens.sources.tables import read_raw_csv, write_csv  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

entries = st.lists(st.tuples(st.text("abé", max_size=3), st.text("abcé", max_size=3)), max_size=12)


@settings(max_examples=1000, deadline=None)
@given(entries, st.text("abcé", max_size=30))
def test_dictionary_as_one_entry_after_the_other(pairs, text):
    want = text
    for key, value in pairs:
        if key and value:
            want = want.replace(key, value)
    assert dictionary.Replacer(pairs)(text) == want


def test_dictionary_column(spark, column):
    values = [None, "", "con bar coñd ban", "zq never"]
    want = column(lambda c: ft.replace_substrings(c, ft.dictionary_column(LONG_DICTIONARY)), values)
    assert column(lambda c: dictionary.replace_entries(c, LONG_DICTIONARY), values) == want
    assert want[2] == "coñ bař coND bañ"
    assert column(lambda c: dictionary.replace_entries(c, []), values) == values


def test_entries_that_never_occur_are_not_applied():
    many = [(f"{a}{b}{c}#", "x") for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    replacer = dictionary.Replacer([("a", "b"), *many, ("b", "c")])
    assert replacer("a plain a") == "c plcin c"
    assert set(replacer.after) <= {0, len(many) + 1}


PROFILES = "doc long, key long, terms array<long>, weights array<double>"


def profiles(spark, count, clusters=0, seed=3):
    random = np.random.default_rng(seed)
    rows = []
    for doc in range(count):
        own = [t for t in range(200) if not clusters or t % clusters == doc % clusters]
        terms = sorted(random.choice(own, random.integers(0, 12), replace=False).tolist())
        weights = random.integers(1, 5, len(terms)).astype(float)
        length = np.sqrt((weights**2).sum())
        rows.append((doc, doc, terms, (weights / length).tolist() if terms else []))
    rows[1] = (1, 1, rows[2][2], rows[2][3])
    return spark.createDataFrame(rows, PROFILES).repartition(3), rows


@pytest.mark.parametrize("clusters", [0, 5])
def test_index_as_all_products(spark, tmp_path, clusters):
    df, rows = profiles(spark, 300, clusters)
    index.save_index(index.build_index(df, block=4, blocks=5), str(tmp_path / "index"))
    stored = index.load_index(spark, str(tmp_path / "index"))
    sources = df.where("doc % 7 = 0 OR doc < 4")
    got = sorted((r["src"], r["rank"], r["rec"], round(r["sim"], 9)) for r in index.search(stored, sources, 6, chunk_terms=50).collect())
    plain = sorted((r["src"], r["rank"], r["rec"], round(r["sim"], 9)) for r in similar.top_documents(df, sources, 6).collect())
    assert got == plain and len(got) == 6 * sources.count()
    scored = {r["src"]: r["scored"] for r in index.documents_scored(stored, sources, 6).collect()}
    shared = {i: sum(bool(set(rows[i][2]) & set(r[2])) for r in rows) for i in scored}
    assert all(scored[i] <= shared[i] for i in scored)
    assert index.search(stored, sources.limit(0), 6).count() == 0


def test_long_documents_make_small_groups(spark):
    """A group holds about as many terms as allowed, however few documents these are."""
    df, rows = profiles(spark, 300)
    built = index.build_index(df, block=4, blocks=5, group_terms=40)
    most = max(len(r[2]) for r in rows)
    held = built.postings.groupBy("group").agg(F.sum(F.size("docs")).alias("n"), F.countDistinct("block").alias("blocks")).collect()
    assert max(r["n"] for r in held) <= 40 + most and max(r["blocks"] for r in held) <= 5
    sources = df.where("doc % 7 = 0")
    got = sorted((r["src"], r["rank"], r["rec"], round(r["sim"], 9)) for r in index.search(built, sources, 6).collect())
    assert got == sorted((r["src"], r["rank"], r["rec"], round(r["sim"], 9)) for r in similar.top_documents(df, sources, 6).collect())


def test_index_is_written_once(spark, tmp_path, monkeypatch):
    """With a path, neither profiles nor postings are stored anywhere else, and the index is the same."""
    df, _ = profiles(spark, 300)
    plain = index.build_index(df, block=4, blocks=5)
    stored = []
    made = index.materialise
    monkeypatch.setattr(index, "materialise", lambda t: stored.append(t.columns) or made(t))
    index.build_index(df, block=4, blocks=5, path=str(tmp_path / "index"))
    assert not any({"terms", "docs", "weights"} & set(c) for c in stored)
    loaded = index.load_index(spark, str(tmp_path / "index"))
    for name in index.Index._fields:
        want, got = getattr(plain, name), getattr(loaded, name)
        assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    files = loaded.postings.groupBy(F.input_file_name()).agg(F.min("group").alias("a"), F.max("group").alias("b")).orderBy("a", "b").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(files, files[1:]))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_artefacts_hold_the_only_copy_of_the_counts(spark, monkeypatch):
    from reviewlens.catalog import similar as queries

    stored, paths = [], []
    made, written = features.materialise, queries.save_artefacts
    monkeypatch.setattr(features, "materialise", lambda t: stored.append(t.columns) or made(t))
    monkeypatch.setattr(queries, "materialise", lambda t: stored.append(t.columns) or made(t))
    monkeypatch.setattr(queries, "save_artefacts", lambda tables, path, **o: paths.append(path) or written(tables, path, **o))
    ENTRIES["artefacts_roundtrip"].run(spark, FOLDER)
    assert stored and not any("tf" in c for c in stored)
    counts = load_artefacts(spark, paths[0], ("counts",))["counts"]
    files = counts.groupBy(F.input_file_name()).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(files, files[1:]))


def test_index_skips_documents(spark):
    """Queries with near copies: once these are found, nothing else can come near."""
    random = np.random.default_rng(4)
    rows = []
    for doc in range(2000):
        group = np.random.default_rng(doc // 10)
        terms = sorted(group.choice(3000, 40, replace=False).tolist())
        weights = group.integers(1, 9, 40) + random.normal(0, 0.05, 40)
        rows.append((doc, doc, terms, (weights / np.sqrt((weights**2).sum())).tolist()))
    built = index.build_index(spark.createDataFrame(rows, PROFILES).repartition(4), block=16, blocks=8)
    scored = index.documents_scored(built, built.profiles.where("doc % 100 = 0"), 5).agg(F.avg("scored")).first()[0]
    assert scored < 2000 / 3


def test_artefacts_hold_profiles_and_nothing_is_written_for_unknown_names(spark, tmp_path):
    df, _ = profiles(spark, 20)
    path = str(tmp_path / "artefacts")
    save_artefacts({"documents": df.select("doc"), "profiles": df}, path)
    saved = load_artefacts(spark, path, ("documents", "profiles"))
    assert saved["profiles"].exceptAll(df).isEmpty() and saved["documents"].count() == 20
    with pytest.raises(ValueError, match="pictures"):
        save_artefacts({"documents": df.select("doc").limit(1), "pictures": df}, path)
    assert load_artefacts(spark, path, ("documents",))["documents"].count() == 20


def plain_nearest(rows, k):
    width = max(len(v) for _, v in rows if v)
    x = np.array([v if v else [0.0] * width for _, v in rows], float)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    scores = np.rint(x @ x.T * 1e9).astype(int)
    ids = [i for i, _ in rows]
    out = []
    for i, a in enumerate(ids):
        best = sorted((-scores[i, j], b) for j, b in enumerate(ids) if b != a)[:k]
        out += [(a, r, b, -s / 1e9) for r, (s, b) in enumerate(best, 1)]
    return sorted(out)


def test_nearest_items_as_all_products(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    random = np.random.default_rng(8)
    centres = random.normal(size=(12, 6))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 12] + random.normal(size=6) / 40).tolist()) for i in range(400)]
    rows[5], rows[8], rows[11] = (5, None), (8, [0.0] * 6), (11, (-centres[1]).tolist())
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = nearest.nearest_items(df, "id", "v", 7)
    assert got.columns == ["query", "id", "cosine", "rank"]
    assert sorted((r["query"], r["rank"], r["id"], round(r["cosine"], 9)) for r in got.collect()) == plain_nearest(rows, 7)
    assert nearest.nearest_items(df.limit(0), "id", "v", 7).count() == 0


def test_nearest_items_skip_far_cells(spark):
    """Around four times as many centres, products grow in proportion to the vectors and not to their square."""
    random = np.random.default_rng(9)
    done = []
    for count in (10, 40):
        centres = random.normal(size=(count, 8))
        rows = [(i, (centres[i % count] + random.normal(size=8) / 60).tolist()) for i in range(count * 100)]
        got = nearest.products_done(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), "id", "v", 5).first()
        done.append(got["products"] / got["vectors"] ** 2)
    assert done[1] < done[0] / 2


def test_nearest_vectors_travel_once_per_pair_of_chunks(spark, monkeypatch):
    """Vectors that no cell tells apart: a block is sent to a bounded number of chunks, not to every other block."""
    monkeypatch.setattr(nearest, "BLOCK", 8)
    random = np.random.default_rng(10)
    rows = [(i, random.normal(size=24).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    _, _, met, blocks, _ = nearest._prepared(df, "id", "v", 4, nearest.PIVOTS)
    most = met.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert blocks.count() > 60 and most <= nearest.PARTS + 1
    single = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got = nearest.nearest_items(df, "id", "v", 3)
    assert sorted((r["query"], r["rank"], r["id"], round(r["cosine"], 9)) for r in got.collect()) == plain_nearest(single, 3)


@pytest.fixture(scope="module")
def lexicon(spark):
    texts = ["new york city is big", "i love new york city", "new york city new york city", "york is old", "new is new"] * 3 + ["the room of the hotel"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return df, phrases.learn_phrases(df, "text", least_count=5, least_score=2.0)


def test_phrases_grow_in_rounds(lexicon):
    got = {r["phrase"]: (r["words"], r["n"]) for r in lexicon[1].collect() if r["words"] > 1}
    assert got["new_york"] == (2, 12) and got["york_city"] == (2, 12) and got["new_york_city"] == (3, 12)


def likeliest(tokens, counts, total):
    """All segmentations, by brute force."""
    cost = lambda p: math.log(total) - math.log(counts[p]) if p in counts else (math.log(total + 1) if "_" not in p else math.inf)

    def best(end):
        if not end:
            return 0.0, []
        return min(((c + cost("_".join(tokens[at:end])), [*s, "_".join(tokens[at:end])]) for at in range(max(0, end - 3), end) for c, s in [best(at)]), key=lambda x: x[0])

    return best(len(tokens))[0]


def test_segmentation_is_the_likeliest(spark, lexicon):
    counts, total = phrases.phrase_shares(lexicon[1])
    segment = phrases.Segmenter(counts, total)
    random = np.random.default_rng(10)
    words = ["new", "york", "city", "room", "hotel", "of", "the", "unseen"]
    for _ in range(300):
        tokens = random.choice(words, random.integers(0, 9)).tolist()
        got = segment(tokens)
        assert "_".join(got).split("_") == tokens or not tokens
        cost = sum(math.log(total) - math.log(counts[p]) if p in counts else math.log(total + 1) for p in got)
        assert cost == pytest.approx(likeliest(tokens, counts, total))


def test_compounds_of_a_stop_list_match(spark, lexicon):
    """Entries written with ``_`` find nothing among plain words, but do among compounds."""
    tokenise = phrases.compound_tokens(*phrases.phrase_shares(lexicon[1]))
    df = spark.createDataFrame([(1, "I love New York City a lot"), (2, None)], "doc long, text string")
    got = {r["doc"]: r["w"] for r in df.select("doc", tokenise(F.col("text")).alias("w")).collect()}
    assert got == {1: ["love", "new_york_city", "lot"], 2: None}
    kept = features.term_counts(df, ["doc"], ["text"], lambda t: F.filter(tokenise(t), lambda w: ~w.isin("new_york_city")))
    assert {r["term"] for r in kept.collect()} == {"love", "lot"}


def test_compounds_by_a_lexicon_of_any_size(spark, lexicon, monkeypatch):
    """The phrases meet the texts by a join: nothing is collected, and rows may repeat or have nulls."""
    counts, total = phrases.phrase_shares(lexicon[1])
    segment = phrases.Segmenter(counts, total)
    monkeypatch.setattr(phrases, "phrase_shares", None)
    random = np.random.default_rng(11)
    words = ["new", "york", "city", "room", "hotel", "of", "the", "unseen"]
    lists = [None, [], *(random.choice(words, random.integers(0, 12)).tolist() for _ in range(200))]
    df = spark.createDataFrame([(i % 50 or None, t, t) for i, t in enumerate(lists)], "id long, was array<string>, t array<string>")
    got = phrases.compound_texts(df, "t", lexicon[1]).collect()
    assert len(got) == len(lists) and all(r["t"] == (segment(r["was"]) if r["was"] else r["was"]) for r in got)
    assert any("_" in w for r in got for w in r["t"] or [])


def test_pairs_are_counted_by_hash_before_they_move_as_text(spark, monkeypatch):
    """Of pairs that are too rare only a few reach the count by text."""
    df = spark.createDataFrame([(f"one{i} two{i} red house",) for i in range(600)], "text string")
    seen = []
    made = phrases.sieve
    monkeypatch.setattr(phrases, "sieve", lambda keys: seen.append(keys.count()) or made(keys))
    got = {r["phrase"]: r["n"] for r in phrases.learn_phrases(df, "text").collect() if r["words"] > 1}
    assert seen[0] == 1 and not got  # only "red_house" is frequent, and no more so than its words
    assert phrases.learn_phrases(df, "text", least_score=0.5).where("phrase = 'red_house' AND n = 600").count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_compound_words_of_all_documents(spark):
    """The registered query against a segmentation that tries every start of every segment."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    counts, total = phrases.phrase_shares(phrases.learn_phrases(documents, "text"))
    tokens = {r["doc_id"]: r["w"] for r in documents.select("doc_id", ft.terms(F.col("text")).alias("w")).collect()}
    price = {p: math.log(total) - math.log(n) for p, n in counts.items()}
    price_of = lambda p: price.get(p, math.log(total + 1) if "_" not in p else math.inf)
    compounds = 0
    for r in ENTRIES["compound_words"].run(spark, FOLDER).collect():
        words, least = tokens[r["doc_id"]], [0.0]
        for end in range(1, len(words) + 1):
            least.append(min(least[at] + (price_of(words[at]) if at == end - 1 else price.get("_".join(words[at:end]), math.inf)) for at in range(max(0, end - 3), end)))
        got = r["text"].split(" ") if r["text"] else []
        assert sum(map(lambda p: price.get(p, math.log(total + 1)), got)) == pytest.approx(least[-1])
        assert "_".join(got) == "_".join(words) and r["n_tokens"] == len(got)
        compounds += r["n_compounds"]
    assert compounds > 0
