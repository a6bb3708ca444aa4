"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.catalog.base import Registry, table
from reviewlens.llm import bloom, bpe, decontaminate, epsilon, jaccard, langid, lines, negatives, pii, pivots, quality, runs, secrets
from reviewlens.llm.spans import count, written
from reviewlens.plans.sizing import materialise

ENTRIES = Registry()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAST_QUALITY = 0.7
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def encoded(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns of the documents with ids, their number, and digests of the ids and of what they decode to."""
    ranks = bpe.load_ranks(RANKS)
    back = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=keep, decoded="decoded")
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return back.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )


@ENTRIES.add()
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, by their number and digest, and the digest of the decoded text."""
    return encoded(table(spark, folder, "documents"), "doc_id").drop("ids")


@ENTRIES.add()
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 90 % or more."""
    return jaccard.near_copies(table(spark, folder, "documents"), k=3, percent=90)


@ENTRIES.add()
def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of embeddings of one label with a cosine of 0.93 or more."""
    return epsilon.near_vectors(table(spark, folder, "embeddings"), least=0.93)


@ENTRIES.add()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, by models of the training folds."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@ENTRIES.add()
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


@ENTRIES.add()
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "spans")
    counts = [count(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    base = F.sha2(written(F.col("spans"), secrets.KINDS, base_only=True), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), written(F.col("spans"), secrets.KINDS).alias("spans"))


@ENTRIES.add()
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that occur in documents: one row per document and item, with the number of errors."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_matches(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.col("m.errors").alias("n_errors"))


LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
keyed AS (
  SELECT doc_id, place, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM keyed
         WHERE key NOT IN (SELECT key FROM often) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM often)) AS n_dropped
            FROM keyed GROUP BY doc_id)
SELECT counted.doc_id, n_lines, n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM counted LEFT JOIN kept ON counted.doc_id = kept.doc_id"""


@ENTRIES.add(LINES_SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that ten documents or more share."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.drop_frequent_lines(docs, least_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


URL_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts),
listed AS (SELECT DISTINCT host FROM ruled WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/'))
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


@ENTRIES.add(URL_SQL)
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on urls: by the longest rule, else by whether the host has a page that a rule blocks."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, path = bloom.split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = bloom.longest_rule(F.col("host"), F.col("path"), URL_RULES)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    hosts = materialise(ruled.groupBy("host").agg(F.coalesce(F.max(F.col("ruled") == "block"), F.lit(False)).alias("listed")))
    marked = bloom.mark_listed(ruled, "host", hosts.where("listed").select("host"), hosts.select("host"))
    found = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", "rule", found.alias("verdict"))


@ENTRIES.add()
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [count(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    base = F.sha2(written(F.col("spans"), pii.KINDS, base_only=True), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), written(F.col("spans"), pii.KINDS).alias("spans"))


NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
           FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (SELECT anchor, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scores WHERE same) WHERE place <= 5),
windows AS (SELECT p.anchor, p.id AS positive, p.score AS positive_score, n.id AS negative, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, positive_score, negative_score
FROM windows WHERE rank <= 5"""


@ENTRIES.add(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of other labels that score close below the best rows of an anchor's label."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


#: The polynomial of CRC-32 in reversed bit order.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
RUNS_SQL = f"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, {CRC_SQL} AS h FROM documents),
ends AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM ends),
texts AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM periods),
words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM texts),
often AS (SELECT * FROM words QUALIFY count(*) OVER (PARTITION BY doc_id, word) >= 4),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
firsts AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN firsts ON d.doc_id = firsts.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def planted(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them with a text that repeats itself from some word on."""
    word = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = F.col("h") % 10 == 0
    cut = hashed.withColumn("w", F.when(chosen, word)).withColumn("n", F.size("w").cast("long"))
    cut = cut.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int")))
    return cut.select("doc_id", F.when(chosen & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@ENTRIES.add(RUNS_SQL)
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, and the digest of the text without the repeats."""
    docs = planted(table(spark, folder, "documents").select("doc_id", "text"))
    found = runs.find_runs(docs)
    most = runs.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


PRODUCTS_SQL = """
WITH rows AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
           FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10"""


@ENTRIES.add(PRODUCTS_SQL)
def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors with the largest integer inner product, for every hundredth vector."""
    return pivots.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
