"""Queries on documents, TF-IDF weights and content-based recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.catalog.base import Registry, quoted, rounded, table, texts
from reviewlens.functions import text as ft
from reviewlens.operators import features, index, joins, nearest, similar
from reviewlens.plans.sizing import materialise
from reviewlens.session import shared_folder
from reviewlens.sources.artefacts import load_artefacts, save_artefacts

ENTRIES = Registry()
TERMS_SQL = rf"regexp_extract_all(lower(text), '{ft.TERM_PATTERN}')"
STOP_WORDS = ft.LANGUAGE_WORDS["en"]
KEYWORD = "000[1-3]$"


# Single texts as documents.
def _texts(spark, folder):
    return texts(spark, folder, F.col("doc_id").alias("doc"), "text")


_COUNTS_SQL = f"counts AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL)"


def _weights_sql(scheme: str, total: str) -> str:
    """CTEs from ``counts`` to unit-length ``weights``."""
    idf = {"smooth": f"ln(({total} + 1.0) / (df + 1)) + 1", "log2": f"log2({total} * 1.0 / df)"}[scheme]
    return f"""
idf AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS df FROM counts GROUP BY term)),
raw AS (SELECT doc, term, tf * idf AS raw FROM counts JOIN idf USING (term) WHERE tf * idf > 0),
norms AS (SELECT doc, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc),
weights AS (SELECT doc, term, raw / norm AS weight FROM raw JOIN norms USING (doc))"""


@ENTRIES.add(f"WITH {_COUNTS_SQL}, {_weights_sql('smooth', '(SELECT count(*) FROM documents)')} SELECT doc, term, round(weight, 6) AS weight FROM weights")
def tfidf_smooth(spark, folder):
    documents = _texts(spark, folder)
    weights = features.tfidf(features.term_counts(documents, ["doc"], ["text"], unique=True), documents, "smooth")
    return rounded(weights, 6, "weight")


_TOKENS_SQL = rf"""list_filter(string_split_regex(regexp_replace(text, '[!-/:-@\[-`{{-~]', ' ', 'g'), '[\s\x0b\x85\p{{Z}}]+'), lambda w: w <> '' AND w NOT IN ({quoted(STOP_WORDS)}))"""
_BAG_SQL = f"counts AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY ALL)"


def _bag(spark, folder):
    return features.term_counts(_texts(spark, folder), ["doc"], ["text"], ft.stripped_tokens(STOP_WORDS), unique=True)


@ENTRIES.add(f"WITH {_BAG_SQL} SELECT doc, term, tf FROM counts")
def bag_of_words(spark, folder):
    return _bag(spark, folder)


@ENTRIES.add(f"WITH {_BAG_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY term")
def vocabulary(spark, folder):
    return features.vocabulary(_bag(spark, folder))


@ENTRIES.add(f"WITH {_BAG_SQL}, {_weights_sql('log2', '(SELECT count(*) FROM documents)')} SELECT doc, term, round(weight, 6) AS weight FROM weights")
def tfidf_log2(spark, folder):
    return rounded(features.tfidf(_bag(spark, folder), _texts(spark, folder), "log2"), 6, "weight")


# Sources as entities, described by the supplier of the same number; languages as variants.
def _entities(spark, folder):
    suppliers, nations = table(spark, folder, "supplier"), table(spark, folder, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.col("s_name").alias("name"),
        F.col("n_name").alias("address"),
    )


_ENTITIES_SQL = "entities AS (SELECT 'src' || s_suppkey AS source, s_name AS name, n_name AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_ROWS_SQL = f"""{_ENTITIES_SQL},
rows AS (SELECT source, lang, name, address FROM (SELECT DISTINCT source, lang FROM documents) LEFT JOIN entities USING (source))"""
_DOCS_SQL = f"{_ROWS_SQL}, docs AS (SELECT *, row_number() OVER (ORDER BY source, lang) - 1 AS doc FROM rows)"


@ENTRIES.add(f"WITH {_ROWS_SQL} SELECT * FROM rows")
def corpus_join(spark, folder):
    return joins.corpus_rows(table(spark, folder, "documents"), _entities(spark, folder), "source", "lang", ["name", "address"])


def _documents(spark, folder, dedup: bool = False):
    return features.documents_per_entity(
        table(spark, folder, "documents"), _entities(spark, folder), entity="source",
        variant="lang", body="text", attributes=["name", "address"], text_attributes=["name", "lang", "address"],
        order_by=["doc_id"], dedup=dedup,
    )


@ENTRIES.add(f"""
WITH {_ROWS_SQL},
bodies AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS body FROM documents GROUP BY source),
contents AS (SELECT rows.*, concat_ws(' ', body, coalesce(name, ''), lang, coalesce(address, '')) AS content FROM rows JOIN bodies USING (source)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY source, lang) AS r FROM contents)
SELECT row_number() OVER (ORDER BY source, lang) - 1 AS doc, source, lang, name, address FROM firsts WHERE r = 1
""")
def corpus_documents(spark, folder):
    return _documents(spark, folder, dedup=True)


def _entity_counts_sql(tokens_of) -> str:
    attributes = "concat_ws(' ', coalesce(name, ''), lang, coalesce(address, ''))"
    return f"""{_DOCS_SQL},
bodies AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest({tokens_of('text')}) AS term FROM documents) GROUP BY ALL),
pieces AS (SELECT doc, term, tf FROM docs JOIN bodies USING (source)
  UNION ALL SELECT doc, term, 1 FROM (SELECT doc, unnest({tokens_of(attributes)}) AS term FROM docs)),
counts AS (SELECT doc, term, CAST(sum(tf) AS BIGINT) AS tf FROM pieces GROUP BY ALL)"""


def _terms_of(text: str) -> str:
    return TERMS_SQL.replace("lower(text)", f"lower({text})")


def _tokens_of(text: str) -> str:
    return _TOKENS_SQL.replace("regexp_replace(text,", f"regexp_replace({text},")


def _entity_counts(spark, folder, documents, tokenise=ft.terms):
    return features.entity_term_counts(
        texts(spark, folder, "source", "text"), documents, entity="source", body="text", text_attributes=["name", "lang", "address"], tokenise=tokenise
    )


@ENTRIES.add(f"WITH {_entity_counts_sql(_terms_of)} SELECT doc, term, tf FROM counts")
def corpus_terms(spark, folder):
    return _entity_counts(spark, folder, _documents(spark, folder))


_PAIRS_SQL = f"""
matches AS (SELECT * FROM docs WHERE regexp_matches(name, '{KEYWORD}')),
shared AS (SELECT q.doc AS src, d.doc AS rec, sum(q.weight * d.weight) AS dot
  FROM weights q JOIN matches m ON q.doc = m.doc JOIN weights d ON q.term = d.term GROUP BY q.doc, d.doc),
pairs AS (SELECT m.doc AS src, d.doc AS rec, round(coalesce(dot, 0), 9) AS sim
  FROM matches m CROSS JOIN docs d LEFT JOIN shared ON shared.src = m.doc AND shared.rec = d.doc WHERE m.doc <> d.doc)"""
_SMOOTH_SQL = f"WITH {_entity_counts_sql(_terms_of)}, {_weights_sql('smooth', '(SELECT count(*) FROM docs)')}, {_PAIRS_SQL}"
_LOG2_SQL = f"WITH {_entity_counts_sql(_tokens_of)}, {_weights_sql('log2', '(SELECT count(*) FROM docs)')}, {_PAIRS_SQL}"


def _smooth(spark, folder):
    documents = _documents(spark, folder)
    weights = features.tfidf(_entity_counts(spark, folder, documents), documents, "smooth")
    # Stored, as the saved profiles a recommender is served from would be.
    return documents, materialise(similar.document_profiles(weights, documents, "source"))


@ENTRIES.add(f"""{_SMOOTH_SQL},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, rec) AS INTEGER) AS rank FROM pairs)
SELECT src, rec, round(sim, 6) AS sim, rank FROM ranked WHERE rank <= 20
""")
def similar_docs(spark, folder):
    documents, profiles = _smooth(spark, folder)
    found = similar.top_documents(profiles, similar.find_by_keyword(documents, "name", KEYWORD), 20)
    return rounded(found, 6, "sim")


@ENTRIES.add(f"""{_SMOOTH_SQL},
named AS (SELECT p.*, r.source AS rec_entity FROM pairs p JOIN docs r ON p.rec = r.doc),
best AS (SELECT *, row_number() OVER (PARTITION BY src, rec_entity ORDER BY sim DESC, rec) AS b FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, rec) AS rank FROM best WHERE b = 1)
SELECT src AS source_doc, CAST(rank AS INTEGER) AS rank, s.source AS source_id, s.name AS source_name, r.source AS recommended_id, r.name AS recommended_name,
  r.address, round_even(sim, 3) AS similarity
FROM ranked JOIN docs s ON src = s.doc JOIN docs r ON rec = r.doc WHERE rank <= 5
""")
def recommend_keyword_per_source(spark, folder):
    documents, profiles = _smooth(spark, folder)
    return similar.recommend_per_source(profiles, documents, entity="source", name="name", keyword=KEYWORD, k=5, attributes=["address"])


@ENTRIES.add(f"""{_SMOOTH_SQL},
named AS (SELECT p.*, round_even(sim, 3) AS similarity, r.source AS rec_entity, s.source AS src_entity FROM pairs p
  JOIN docs r ON p.rec = r.doc JOIN docs s ON p.src = s.doc),
best AS (SELECT *, row_number() OVER (PARTITION BY rec_entity ORDER BY similarity DESC, src_entity, src, rec) AS b FROM named WHERE src_entity <> rec_entity),
top AS (SELECT * FROM best WHERE b = 1 ORDER BY similarity DESC, rec_entity LIMIT 10)
SELECT s.source AS source_id, s.name AS source_name, r.source AS recommended_id, r.name AS recommended_name, r.address, similarity
FROM top JOIN docs s ON src = s.doc JOIN docs r ON rec = r.doc
""")
def recommend_keyword_other_entities(spark, folder):
    documents, profiles = _smooth(spark, folder)
    return similar.recommend_pooled(
        profiles, documents, entity="source", name="name", keyword=KEYWORD, k=10, attributes=["address"], exclude_self="entity"
    )


@ENTRIES.add(f"""{_SMOOTH_SQL},
named AS (SELECT p.*, round_even(sim, 3) AS similarity, r.source AS rec_entity, s.source AS src_entity FROM pairs p
  JOIN docs r ON p.rec = r.doc JOIN docs s ON p.src = s.doc),
best AS (SELECT *, row_number() OVER (PARTITION BY rec_entity ORDER BY similarity DESC, src_entity, src, rec) AS b FROM named),
top AS (SELECT * FROM best WHERE b = 1 ORDER BY similarity DESC, rec_entity LIMIT 10)
SELECT s.source AS source_id, s.name AS source_name, r.source AS recommended_id, r.name AS recommended_name, r.address, similarity
FROM top JOIN docs s ON src = s.doc JOIN docs r ON rec = r.doc
""")
def recommend_keyword_pooled(spark, folder):
    documents, profiles = _smooth(spark, folder)
    return similar.recommend_pooled(profiles, documents, entity="source", name="name", keyword=KEYWORD, k=10, attributes=["address"])


_INDEX_SQL = f"""{_LOG2_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, rec) AS rank FROM pairs),
named AS (SELECT src, rank, sim, s.name AS source_name, r.name AS recommended_name, r.address FROM ranked
  JOIN docs s ON src = s.doc JOIN docs r ON rec = r.doc WHERE rank <= 5),
firsts AS (SELECT *, row_number() OVER (PARTITION BY recommended_name ORDER BY src, rank) AS f FROM named)
SELECT source_name, recommended_name, address, round(sim, 6) AS score FROM firsts WHERE f = 1
"""


def _log2(spark, folder):
    documents = _documents(spark, folder)
    weights = features.tfidf(_entity_counts(spark, folder, documents, ft.stripped_tokens(STOP_WORDS)), documents, "log2")
    return documents, materialise(similar.document_profiles(weights, documents))


@ENTRIES.add(_INDEX_SQL)
def recommend_stored_index(spark, folder):
    """The same from a saved inverted index."""
    documents, profiles = _log2(spark, folder)
    path = shared_folder(spark)
    index.build_index(profiles, path=path)
    stored = index.load_index(spark, path)
    found = similar.recommend_from_index(stored, documents, entity="source", name="name", keyword=KEYWORD, k=5, attributes=["address"])
    return rounded(found, 6, "score")


@ENTRIES.add(_INDEX_SQL)
def recommend_index(spark, folder):
    documents, profiles = _log2(spark, folder)
    found = similar.recommend_from_index(profiles, documents, entity="source", name="name", keyword=KEYWORD, k=5, attributes=["address"])
    return rounded(found, 6, "score")


@ENTRIES.add(f"WITH {_DOCS_SQL} SELECT doc, source, lang, name, address FROM docs WHERE regexp_matches(name, '{KEYWORD}')")
def find_by_keyword(spark, folder):
    return similar.find_by_keyword(_documents(spark, folder), "name", KEYWORD)


@ENTRIES.add(f"WITH {_COUNTS_SQL}, {_weights_sql('smooth', '(SELECT count(*) FROM documents)')} SELECT doc, term, round(weight, 6) AS weight, tf FROM weights JOIN counts USING (doc, term)")
def artefacts_roundtrip(spark, folder):
    documents = _texts(spark, folder)
    path = shared_folder(spark)
    save_artefacts({"documents": documents}, path)
    documents = load_artefacts(spark, path, ("documents",))["documents"]
    # Texts are smaller than their counts: they are dealt by ranges, and the counts are taken and saved where they lie.
    counts = features.term_counts(documents.repartitionByRange("doc"), ["doc"], ["text"], unique=True)
    save_artefacts({"counts": counts}, path, placed=("counts",))
    counts = load_artefacts(spark, path, ("counts",))["counts"]
    save_artefacts({"vocabulary": features.vocabulary(counts), "weights": features.tfidf(counts, documents, stored=True)}, path)
    stored = load_artefacts(spark, path)
    return rounded(stored["weights"].join(stored["counts"], ["doc", "term"]), 6, "weight")


@ENTRIES.add(f"""
WITH {_COUNTS_SQL}, {_weights_sql('smooth', '(SELECT count(*) FROM documents)')},
shared AS (SELECT q.doc AS src, d.doc AS rec, sum(q.weight * d.weight) AS dot FROM weights q JOIN weights d ON q.term = d.term
  WHERE q.doc % 20 = 0 GROUP BY q.doc, d.doc),
pairs AS (SELECT m.doc_id AS src, d.doc_id AS rec, round(coalesce(dot, 0), 9) AS sim FROM documents m JOIN documents d
  ON m.doc_id % 20 = 0 AND m.doc_id <> d.doc_id LEFT JOIN shared ON shared.src = m.doc_id AND shared.rec = d.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, rec) AS INTEGER) AS rank FROM pairs)
SELECT src, rec, round(sim, 6) AS sim, rank FROM ranked WHERE rank <= 10
""")
def index_topk(spark, folder):
    """The saved index, asked for every twentieth document."""
    documents = _texts(spark, folder)
    weights = features.tfidf(features.term_counts(documents, ["doc"], ["text"], unique=True), documents, "smooth")
    path = shared_folder(spark)
    index.build_index(materialise(similar.document_profiles(weights, documents)), path=path)
    found = index.search(index.load_index(spark, path), documents.where("doc % 20 = 0"), 10)
    return rounded(found, 6, "sim")


# Label centroids as the second vector of each row.
def _centroids(spark, folder):
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per vector dimension.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda c: c["x"]).alias("centroid"))


_CENTROIDS_SQL = """
cells AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centroids AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS x FROM cells GROUP BY label, pos) GROUP BY label)"""
_COSINE_SQL = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid)"


@ENTRIES.add(f"WITH {_CENTROIDS_SQL} SELECT vec_id, e.label, round({_COSINE_SQL}, 6) AS cosine FROM embeddings e JOIN centroids USING (label)")
def vector_cosine(spark, folder):
    paired = joins.join_lookup(table(spark, folder, "embeddings"), _centroids(spark, folder), ["label"], "inner")
    return rounded(similar.vector_cosines(paired, "embedding", "centroid"), 6, "cosine").select("vec_id", "label", "cosine")


@ENTRIES.add(f"""WITH {_CENTROIDS_SQL},
ranked AS (SELECT CAST(c.label AS BIGINT) AS query, vec_id, round({_COSINE_SQL}, 9) AS cosine FROM embeddings, centroids c),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM ranked)
SELECT query, vec_id, rank, round(cosine, 6) AS cosine FROM top WHERE rank <= 10
""")
def vector_topk(spark, folder):
    queries = _centroids(spark, folder).select(F.col("label").cast("long").alias("query"), F.col("centroid").alias("vector"))
    return rounded(similar.top_vectors(table(spark, folder, "embeddings"), queries, "vec_id", "embedding", 10), 6, "cosine")


_ITEMS_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ranked AS (SELECT a.vec_id AS query, b.vec_id AS vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS cosine
  FROM v a, v b WHERE a.vec_id <> b.vec_id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM ranked)
SELECT query, vec_id, rank, round(cosine, 6) AS cosine FROM top WHERE rank <= 10
"""


@ENTRIES.add(_ITEMS_SQL)
def vector_topk_items(spark, folder):
    items = table(spark, folder, "embeddings")
    queries = items.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return rounded(similar.top_vectors(items, queries, "vec_id", "embedding", 10, exclude_self=True), 6, "cosine")


@ENTRIES.add(_ITEMS_SQL)
def vector_nearest_items(spark, folder):
    """The same by cells around pivots."""
    return rounded(nearest.nearest_items(table(spark, folder, "embeddings"), "vec_id", "embedding", 10), 6, "cosine")
