from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import vectors
from reviewlens.operators import features, index, similar
from reviewlens.plans.scoring import Ranking
from reviewlens.plans.sizing import materialise
from reviewlens.sources.artefacts import load_artefacts, save_artefacts

TEXTS = {
    0: ("A", "Sea Inn", "sea view room pool all"), 1: ("A", "Sea Inn", "sea view suite pool all"),
    2: ("B", "Hill Lodge", "hill view room all"), 3: ("C", "Sea Star", "sea sea beach all"),
    4: ("D", "Void", ""), 5: ("E", "Twin", "hill view room all"), 6: ("F", None, "pool bar all"),
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(d, *v) for d, v in TEXTS.items()], "doc long, entity string, name string, text string")


def reference_weights(scheme):
    counts = {d: Counter(t.split()) for d, (_, _, t) in TEXTS.items()}
    df = Counter(w for c in counts.values() for w in c)
    n = len(TEXTS)
    out = {}
    for d, c in counts.items():
        raw = {w: k * (math.log((1 + n) / (1 + df[w])) + 1 if scheme == "smooth" else math.log2(n / df[w])) for w, k in c.items()}
        raw = {w: x for w, x in raw.items() if x > 0}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out[d] = {w: x / length for w, x in raw.items()} if length else {}
    return out


def reference_cosines(weights, src):
    return {d: sum(x * weights[src].get(w, 0) for w, x in v.items()) for d, v in weights.items()}


def test_counts_in_rows_and_across_rows_agree(documents):
    inside = features.term_counts(documents, ["doc"], ["text", "name"], unique=True)
    across = features.term_counts(documents, ["doc"], ["text", "name"])
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, across.collect()))


def test_tokeniser_may_be_a_vectorised_user_function(spark, documents):
    @F.pandas_udf("array<string>")
    def pairs(texts: pd.Series) -> pd.Series:
        return texts.fillna("").str.split().map(lambda words: ["_".join(p) for p in zip(words, words[1:])])

    found = features.term_counts(documents.filter("doc = 3"), ["doc"], ["text"], pairs)
    assert {r.term: r.tf for r in found.collect()} == {"sea_sea": 1, "sea_beach": 1, "beach_all": 1}


@pytest.fixture(scope="module")
def weights(documents):
    counts = features.term_counts(documents, ["doc"], ["text"])
    return features.tfidf(counts, documents, "smooth")


@pytest.mark.parametrize("max_rows", [1, 1_000_000])
@pytest.mark.parametrize("scheme", ["smooth", "log2"])
def test_tfidf(documents, scheme, max_rows):
    counts = features.term_counts(documents, ["doc"], ["text"])
    made = features.tfidf(counts, documents, scheme, max_rows)
    wanted = {(d, w): x for d, v in reference_weights(scheme).items() for w, x in v.items()}
    found = {(r.doc, r.term): r.weight for r in made.collect()}
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_only_counts_of_rare_terms_are_shuffled(spark):
    """The most frequent terms that fit are broadcast, also if the whole vocabulary does not."""
    rows = [(d, t, 1) for d in range(40) for t in ("all", "half" if d % 2 else "own", f"rare{d}")]
    counts = materialise(spark.createDataFrame(rows, "doc int, term string, tf int"))
    idf = materialise(counts.groupBy("term").agg(F.count("*").alias("df"), F.lit(2.0).alias("idf")))
    for max_rows, far in ((3, 40), (1, 80), (0, 120), (100, 0)):
        made = features._with_idf(counts, idf, max_rows)
        assert sorted(r["term"] for r in made.collect()) == sorted(t for _, t, _ in rows)
        assert ("Union" in made._jdf.queryExecution().toString()) == (0 < far < 120)


def test_hashed_features_split_texts_once(spark):
    _, made = features.hashed_text_features(spark.createDataFrame([("a pool",), ("a view",)], "text string"), features=16)
    assert made.inputFiles() and all("reviewlens-" in f for f in made.inputFiles())


@pytest.fixture(scope="module")
def profiles(documents, weights):
    return materialise(similar.document_profiles(weights, documents, "entity"))


def rank(src, k, plain, exclude=lambda s, d: s == d):
    sims = {d: round(x, 9) for d, x in reference_cosines(plain, src).items() if not exclude(src, d)}
    seen, out = set(), []
    for d in sorted(sims, key=lambda d: (-sims[d], d)):
        if TEXTS[d][0] not in seen:
            seen.add(TEXTS[d][0])
            out.append((d, sims[d]))
    return out[:k]


@pytest.mark.parametrize("terms", [2, 11, 1_000_000])
@pytest.mark.parametrize("mode, k", [("row", 2), ("entity", 2), ("row", 99)])
def test_recommend_per_source(documents, profiles, mode, k, terms):
    rows = similar.recommend_per_source(
        profiles, documents, entity="entity", name="name", keyword="^sea", k=k, exclude_self=mode, query_terms=terms
    ).collect()
    plain = reference_weights("smooth")
    skip = (lambda s, d: s == d) if mode == "row" else (lambda s, d: TEXTS[s][0] == TEXTS[d][0])
    for src in (0, 1, 3):
        mine = [(r.recommended_id, r.similarity) for r in sorted(rows, key=lambda r: r["rank"]) if r.source_doc == src]
        assert mine == [(TEXTS[d][0], round(s, 3)) for d, s in rank(src, k, plain, skip)]
        assert len(mine) == min(k, 6 if mode == "row" and TEXTS[src][0] == "A" else 5)
    assert {r.source_doc for r in rows} == {0, 1, 3}


def test_recommend_pooled(documents, profiles):
    rows = similar.recommend_pooled(profiles, documents, entity="entity", name="name", keyword="sea", k=3).collect()
    assert len({r.recommended_id for r in rows}) == 3
    plain = reference_weights("smooth")
    best = Counter()
    for src in (0, 1, 3):
        for d, s in rank(src, 99, plain):
            best[TEXTS[d][0]] = max(best[TEXTS[d][0]], round(s, 3))
    wanted = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    assert [(r.recommended_id, r.similarity) for r in rows] == wanted


def test_recommend_from_index_keeps_first_row_per_name(documents, profiles):
    rows = similar.recommend_from_index(profiles, documents, entity="entity", name="name", keyword="sea", k=3).collect()
    names = [r.recommended_name for r in rows]
    assert len(names) == len(set(names)) and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    plain = reference_weights("smooth")
    first = {}
    for src in (0, 1, 3):
        sims = {d: s for d, s in reference_cosines(plain, src).items() if d != src}
        for d in sorted(sims, key=lambda d: (-round(sims[d], 9), d))[:3]:
            first.setdefault(TEXTS[d][1], sims[d])
    assert {r.recommended_name: r.score for r in rows} == {n: pytest.approx(s, abs=1e-8) for n, s in first.items()}


def test_equal_similarity_goes_to_the_lower_document(documents, profiles):
    rows = similar.top_documents(profiles, documents.filter("doc = 0"), 9).orderBy("rank").collect()
    order = [r.rec for r in rows]
    assert order.index(2) + 1 == order.index(5)


@pytest.mark.parametrize("block_terms", [3, 1_000_000])
@pytest.mark.parametrize("ranking", [Ranking(3), Ranking(2, exclude_key=True), Ranking(9, 3, tie_on_key=True)])
def test_long_documents_are_rows_per_slice(documents, weights, profiles, monkeypatch, ranking, block_terms):
    """No row holds a whole long document, and the matches are the same."""
    monkeypatch.setattr(similar, "LEAST_TERMS", 1)
    monkeypatch.setattr(similar, "BLOCK_TERMS", 4)
    monkeypatch.setattr(similar, "RANKED_DOCS", 3)
    monkeypatch.setattr(similar, "RANKED_SOURCES", 2)
    cut = materialise(similar.document_profiles(weights, documents, "entity", row_terms=2))
    assert cut.count() > len(TEXTS) and cut.agg(F.max(F.size("terms"))).first()[0] < 4
    whole = {r.doc: sorted(zip(r.terms, r.weights)) for r in profiles.collect()}
    pieces = [(r.doc, *e) for r in cut.collect() for e in zip(r.terms, r.weights)]
    assert sorted(pieces) == sorted((d, *e) for d, es in whole.items() for e in es)
    assert {r.doc: r.key for r in cut.collect()} == {r.doc: r.key for r in profiles.collect()}
    sources = documents.where("doc IN (0, 1, 3, 4)")
    got, want = (sorted(map(tuple, similar.best_matches(p, sources, ranking, block_terms=block_terms).collect())) for p in (cut, profiles))
    assert got == want and got


def test_index_of_long_documents(documents, weights, profiles, monkeypatch):
    monkeypatch.setattr(similar, "LEAST_TERMS", 1)
    cut = materialise(similar.document_profiles(weights, documents, "entity", row_terms=2))
    got, want = (sorted((r.src, r.rec, round(r.sim, 9), r.rank) for r in index.search(index.build_index(p), documents, 3).collect()) for p in (cut, profiles))
    assert got == want and got


def test_no_match_and_empty_document(documents, profiles):
    assert similar.recommend_per_source(profiles, documents, entity="entity", name="name", keyword="nowhere").count() == 0
    rows = similar.recommend_per_source(profiles, documents, entity="entity", name="name", keyword="void", k=3).orderBy("rank").collect()
    assert [(r.recommended_id, r.similarity) for r in rows] == [("A", 0), ("B", 0), ("C", 0)]


@pytest.mark.parametrize("queries", [2, 1000])
def test_nearest_vectors_in_any_number_of_blocks(spark, queries):
    rows = {1: [1.0, 0.0], 2: [1.0, 0.1], 3: [0.0, 1.0], 4: [0.0, 0.0], 5: None, 6: [2.0, 0.0]}
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "id long, v array<double>")
    found = similar.top_vectors(df, df.select(F.col("id").alias("query"), F.col("v").alias("vector")), "id", "v", 2, queries, exclude_self=True)
    best = {(r["query"], r["rank"]): (r["id"], round(r["cosine"], 3)) for r in found.collect()}
    assert len(best) == 12 and best[1, 1] == (6, 1.0) and best[1, 2] == (2, 0.995) and best[3, 1] == (2, 0.1) and best[4, 1] == (1, 0.0)


@pytest.fixture(scope="module")
def review_tables(spark):
    reviews = [("A", "twin", 1, "clean room"), ("A", "suite", 2, "nice  pool"), ("A", None, 3, None), ("B", "twin", 4, "clean room nice  pool"),
               ("C", "twin", 5, "other"), (None, "twin", 6, "lost"), ("D", "twin", 7, "no entity"), ("E", None, 8, "clean"), ("E", "", 9, "x")]
    hotels = [("A", "Inn", "Road 1"), ("B", "Inn", "Road 1"), ("C", "Bar", None), ("E", "Eck", "Lane")]
    return (spark.createDataFrame(reviews, "h string, room string, i int, body string").repartition(4),
            spark.createDataFrame(hotels, "h string, name string, address string"))


def test_documents_with_equal_content_are_kept_once(review_tables):
    reviews, hotels = review_tables
    docs = features.documents_per_entity(
        reviews, hotels, entity="h", variant="room", body="body", attributes=["name", "address"],
        text_attributes=["name", "room", "address"], order_by=["i"],
    ).orderBy("doc").collect()
    bodies, attributes = {}, {r.h: r for r in hotels.collect()}
    for r in sorted(reviews.collect(), key=lambda r: r.i):
        if r.h and r.body is not None:
            bodies.setdefault(r.h, []).append(r.body)
    seen, wanted = set(), []
    pairs = {(r.h, r.room) for r in reviews.collect() if r.h}
    for h, room in sorted(pairs, key=lambda p: (p[0], p[1] is not None, p[1] or "")):
        a = attributes.get(h)
        content = " ".join([" ".join(bodies.get(h, [])), (a and a.name) or "", room or "", (a and a.address) or ""])
        if content not in seen:
            seen.add(content)
            wanted.append((h, room))
    # B's twin room repeats A's, and E's unknown room type reads the same as its empty one.
    assert [(r.h, r.room) for r in docs] == wanted and len(wanted) == 6
    assert [r.doc for r in docs] == list(range(6))


def test_entity_term_counts_equal_counts_of_the_joined_text(review_tables):
    reviews, hotels = review_tables
    docs = features.documents_per_entity(
        reviews, hotels, entity="h", variant="room", body="body", attributes=["name", "address"],
        text_attributes=["name", "room", "address"], order_by=["i"], dedup=False,
    )
    counts = features.entity_term_counts(reviews, docs, entity="h", body="body", text_attributes=["name", "room", "address"])
    twin = docs.filter("h = 'A' AND room = 'twin'").first().doc
    assert {r.term: r.tf for r in counts.filter(F.col("doc") == twin).collect()} == Counter("clean room nice pool inn twin road".split())


def test_vectors(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0], [0.0, 2.0]), (1, [1.0, 1.0], [2.0, 2.0]), (2, [1.0, 0.0], [-3.0, 0.0]), (3, [0.0, 0.0], [1.0, 1.0])],
        "id long, v array<float>, w array<float>",
    )
    assert [r.c for r in similar.vector_cosines(df, "v", "w", "c").orderBy("id").collect()] == pytest.approx([0, 1, -1, 0])
    assert df.select(vectors.norm(F.col("w"))).first()[0] == 2.0


@pytest.mark.parametrize("max_queries", [1, 100])
def test_top_vectors(spark, max_queries):
    df = spark.createDataFrame([(i, [math.cos(i / 5), math.sin(i / 5)]) for i in range(20)], "id long, v array<double>")
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "query string, vector array<double>")
    rows = similar.top_vectors(df, queries, "id", "v", 3, max_queries).orderBy("query", "rank").collect()
    assert [(r.query, r.id) for r in rows] == [("x", 0), ("x", 1), ("x", 2), ("y", 8), ("y", 7), ("y", 9)]


def test_artefacts(spark, documents, weights, tmp_path):
    counts = features.term_counts(documents, ["doc"], ["text"])
    made = {"documents": documents, "counts": counts, "vocabulary": features.vocabulary(counts), "weights": weights}
    save_artefacts(made, str(tmp_path))
    read = load_artefacts(spark, str(tmp_path))
    assert all(sorted(map(str, read[n].collect())) == sorted(map(str, made[n].collect())) for n in made)
    with pytest.raises(ValueError):
        save_artefacts({"index": counts}, str(tmp_path))


def test_top_vectors_with_ties_in_small_steps(spark, monkeypatch):
    """Rows as good as the k-th are kept through every step of a block, and ties go to the smaller id."""
    monkeypatch.setattr(similar, "SCORED_ROWS", 3)
    rows = [(i, [1.0, float(i % 2)] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.select(F.col("id").alias("query"), F.col("v").alias("vector"))
    got = {(r["query"], r["rank"]): r["id"] for r in similar.top_vectors(df, queries, "id", "v", 4, exclude_self=True).collect()}
    for i, v in rows:
        same = [j for j, w in rows if j != i and (w == v if v else True)]
        assert [got[i, r] for r in (1, 2, 3, 4)] == same[:4]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_travel_to_the_queries_in_chunks(spark, monkeypatch, kind):
    """More queries than travel: the vectors come in chunks, no vector is shuffled, and each chunk leaves k rows a query."""
    monkeypatch.setattr(similar, "SENT_BYTES", 300)
    monkeypatch.setattr(similar, "SCORED_ITEMS", 5)
    kept = []
    made = similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda t: kept.append(made(t)) or kept[-1])
    rows = [(i, [1.0, float(i % 3), float(i % 7)] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, f"id long, v array<{kind}>").repartition(3)
    queries = df.select(F.col("id").alias("query"), F.col("v").alias("vector"))
    found = similar.top_vectors(df, queries, "id", "v", 4, max_queries=7, exclude_self=True)
    assert "applyInArrow" not in found._jdf.queryExecution().toString() and "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    chunks = kept[2:]
    assert len(chunks) > 3 and all(t.columns == ["query", "id", "scaled"] and t.count() <= 4 * 60 for t in chunks)
    got = {(r["query"], r["rank"]): (r["id"], round(r["cosine"], 9)) for r in found.collect()}
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] if v else [0.0] * 3 for _, v in rows]
    for i, _ in rows:
        best = sorted((-round(sum(a * b for a, b in zip(unit[i], unit[j])), 9), j) for j, _ in rows if j != i)[:4]
        assert [got[i, r] for r in (1, 2, 3, 4)] == [(j, -c) for c, j in best]
