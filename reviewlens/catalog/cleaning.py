"""Queries on cleaning, de-duplication, joins and the two cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens import hotel
from reviewlens.catalog.base import REVIEWS_SQL, Registry, quoted, reviews, rounded, table
from reviewlens.functions import cleaning as fc
from reviewlens.operators import cleaning, dedup, joins
from reviewlens.plans.audit import Audit
from reviewlens.plans.jobs import clean_entities, clean_reviews
from reviewlens.session import shared_folder
from reviewlens.sources import bucketed
from reviewlens.sources.records import read_records
from reviewlens.sources.tables import read_clean, read_raw_csv, write_csv, write_parquet

ENTRIES = Registry()

# Messy text made from the tables by the same expression in both languages.
QUANTITY = "CAST(CAST(l_quantity AS INT) AS STRING)"
MESSY_SCORE = (
    f"CASE l_linenumber WHEN 1 THEN concat('  ', {QUANTITY}, ',5 ') WHEN 2 THEN concat({QUANTITY}, '.25') "
    f"WHEN 3 THEN 'No Information' WHEN 4 THEN concat('NA', '') WHEN 5 THEN concat('1.', {QUANTITY}, ',5') "
    f"WHEN 6 THEN concat({QUANTITY}, 'd') ELSE NULL END"
)
DIRTY = quoted(fc.DIRTY_TOKENS)
LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _number_sql(text: str) -> str:
    token = f"lower(trim({text}))"
    number = f"replace({token}, ',', '.')"
    return (
        f"CASE WHEN {token} IN ({DIRTY}) THEN NULL "
        f"WHEN regexp_matches({number}, '{fc.DECIMAL_GUARD}') THEN TRY_CAST({number} AS DOUBLE) END"
    )


def _messy_lines(spark, folder):
    keys = [k.strip() for k in LINE_KEY.split(",")]
    return table(spark, folder, "lineitem").select(*keys, F.expr(MESSY_SCORE).alias("raw"))


@ENTRIES.add(f"SELECT {LINE_KEY}, {_number_sql('raw')} AS score FROM (SELECT {LINE_KEY}, {MESSY_SCORE} AS raw FROM lineitem)")
def clean_numeric(spark, folder):
    lines = _messy_lines(spark, folder)
    return cleaning.clean_numbers(lines, ["raw"]).withColumnRenamed("raw", "score")


@ENTRIES.add(
    f"SELECT {LINE_KEY}, CASE WHEN lower(trim(raw)) NOT IN ({DIRTY}) THEN lower(trim(raw)) END AS token "
    f"FROM (SELECT {LINE_KEY}, {MESSY_SCORE} AS raw FROM lineitem)"
)
def clean_dirty_tokens(spark, folder):
    lines = _messy_lines(spark, folder)
    return lines.withColumn("token", fc.clean_token(F.col("raw"))).drop("raw")


# As text that is known to be good, the strict reader must give the same numbers.
@ENTRIES.add(f"SELECT {LINE_KEY}, CAST(l_quantity AS DOUBLE) + 0.5 AS score FROM lineitem")
def clean_numeric_strict(spark, folder):
    keys = [k.strip() for k in LINE_KEY.split(",")]
    lines = table(spark, folder, "lineitem").select(*keys, F.expr(f"concat({QUANTITY}, ',5')").alias("score"))
    return cleaning.clean_numbers(lines, ["score"], strict=True)


@ENTRIES.add(f"""
WITH t AS (SELECT {MESSY_SCORE} AS raw, l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN ' None ' ELSE 'x' END AS status FROM lineitem),
l AS (SELECT 'raw' AS "column", lower(trim(coalesce(raw, 'nan'))) AS token FROM t
      UNION ALL SELECT 'flag', lower(trim(coalesce(flag, 'nan'))) FROM t
      UNION ALL SELECT 'status', lower(trim(coalesce(status, 'nan'))) FROM t)
SELECT "column", string_agg(DISTINCT token, '|' ORDER BY token) AS tokens FROM l WHERE token IN ({DIRTY}) GROUP BY "column"
""")
def dirty_token_scan(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.expr(MESSY_SCORE).alias("raw"), F.col("l_returnflag").alias("flag"),
        F.expr("CASE WHEN l_linestatus = 'F' THEN ' None ' ELSE 'x' END").alias("status"),
    )
    return cleaning.dirty_token_scan(lines).withColumn("tokens", F.array_join("tokens", "|"))


@ENTRIES.add(f"""
WITH t AS (SELECT l_orderkey, {MESSY_SCORE} AS raw, nullif(l_returnflag, 'A') AS flag FROM lineitem)
SELECT 'l_orderkey' AS "column", count(*) AS rows, count(l_orderkey) AS non_null FROM t
UNION ALL SELECT 'raw', count(*), count(raw) FROM t UNION ALL SELECT 'flag', count(*), count(flag) FROM t
""")
def profile(spark, folder):
    lines = table(spark, folder, "lineitem")
    return cleaning.profile(lines.select("l_orderkey", F.expr(MESSY_SCORE).alias("raw"), F.expr("nullif(l_returnflag, 'A')").alias("flag")))


RANK_TEXT = (
    "CASE WHEN p_type = 'PROMO' THEN 'No information' WHEN p_type = 'SMALL' THEN 'sao' WHEN p_type = 'LARGE' THEN NULL "
    "ELSE concat('hạng ', CAST(p_size AS STRING), '.5 sao trên 5') END"
)


@ENTRIES.add(f"""
SELECT p_partkey, TRY_CAST(nullif(regexp_extract({RANK_TEXT}, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS "rank" FROM part
""")
def extract_rank(spark, folder):
    text = fc.clean_token(F.expr(RANK_TEXT))
    return table(spark, folder, "part").select("p_partkey", fc.first_number(text).alias("rank"))


STAY = (
    f"CASE WHEN l_returnflag = 'N' THEN 'không rõ' ELSE concat('Đã ở ', {QUANTITY}, ' đêm vào Tháng  ', "
    "CAST(CAST(month(l_shipdate) AS INT) AS STRING), ' năm 2023') END"
)


@ENTRIES.add(f"SELECT {LINE_KEY}, TRY_CAST(nullif(regexp_extract({STAY}, '{fc.NIGHTS_PATTERN}', 1), '') AS INTEGER) AS nights FROM lineitem")
def extract_nights(spark, folder):
    keys = [k.strip() for k in LINE_KEY.split(",")]
    return table(spark, folder, "lineitem").select(*keys, fc.extract_int(F.expr(STAY), fc.NIGHTS_PATTERN).alias("nights"))


@ENTRIES.add(f"SELECT {LINE_KEY}, TRY_CAST(nullif(regexp_extract({STAY}, '{fc.MONTH_PATTERN}', 1), '') AS INTEGER) AS month FROM lineitem")
def extract_month(spark, folder):
    keys = [k.strip() for k in LINE_KEY.split(",")]
    return table(spark, folder, "lineitem").select(*keys, fc.extract_int(F.expr(STAY), fc.MONTH_PATTERN).alias("month"))


DATE_TEXT = (
    "CASE WHEN o_orderstatus = 'P' THEN 'Đã nhận xét vào 31 tháng 2 2023' WHEN o_orderpriority = '5-LOW' THEN NULL "
    "ELSE concat('Đã nhận xét vào ', CAST(CAST(day(o_orderdate) AS INT) AS STRING), ' tháng ', "
    "CAST(CAST(month(o_orderdate) AS INT) AS STRING), ' ', CAST(CAST(year(o_orderdate) AS INT) AS STRING)) END"
)


@ENTRIES.add(f"""
SELECT o_orderkey, CAST(try_strptime(regexp_extract(t, '{fc.LOCAL_DATE_PATTERN}', 1) || '/' || regexp_extract(t, '{fc.LOCAL_DATE_PATTERN}', 2)
  || '/' || regexp_extract(t, '{fc.LOCAL_DATE_PATTERN}', 3), '%d/%m/%Y') AS DATE) AS day
FROM (SELECT o_orderkey, {DATE_TEXT} AS t FROM orders)
""")
def parse_local_date(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", fc.local_date(F.expr(DATE_TEXT)).alias("day"))


HOLES = (
    "event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, "
    "nullif(event_type, 'view') AS event_type, CASE WHEN value > 100 THEN NULL ELSE props END AS props"
)


@ENTRIES.add(f"""
SELECT event_id, user_id, coalesce(value, 0) AS value, coalesce(event_type, '-') AS event_type, props
FROM (SELECT {HOLES} FROM events) WHERE props IS NOT NULL
""")
def fill_drop_null(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE value END").alias("value"),
        F.expr("nullif(event_type, 'view')").alias("event_type"), F.expr("CASE WHEN value > 100 THEN NULL ELSE props END").alias("props"),
    )
    return cleaning.drop_null_rows(cleaning.fill_nulls(events, {"value": 0.0, "event_type": "-"}), ["props"])


@ENTRIES.add('SELECT event_id AS "Event_ID", user_id AS "User_ID", event_type AS "Type" FROM events')
def rename_headers(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").alias(" Event ID "), F.col("user_id").alias("User ID"), F.col("event_type").alias("Type ")
    )
    return cleaning.normalise_headers(events)


@ENTRIES.add("SELECT p_partkey, p_name, p_size FROM part")
def project_drop(spark, folder):
    chosen = cleaning.project(table(spark, folder, "part"), ["p_partkey", "p_name", "p_size", "p_type"])
    return cleaning.drop_columns(chosen, ["p_type"])


@ENTRIES.add(f"""
WITH {REVIEWS_SQL}
SELECT ordr, item, nights, concat_ws('_', CAST(item AS VARCHAR), name, coalesce(nullif(user, 'NATION_3'), 'nan'),
  coalesce(CAST(CASE WHEN month <> 2 THEN day END AS VARCHAR), 'NaT')) AS key FROM reviews
""")
def review_key(spark, folder):
    key = fc.synthetic_key(
        (F.col("item"), "nan"), (F.col("name"), "nan"), (F.expr("nullif(user, 'NATION_3')"), "nan"),
        (F.expr("CASE WHEN month <> 2 THEN day END"), "NaT"),
    )
    return reviews(spark, folder).select("ordr", "item", "nights", key.alias("key"))


@ENTRIES.add("SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS repeated FROM documents")
def dup_count(spark, folder):
    return dedup.repeated_count(table(spark, folder, "documents"), ["text"], digest=True)


@ENTRIES.add("""
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1
""")
def dup_rows(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return dedup.repeated_rows(documents, ["text"], ["doc_id"], digest=True).drop("text")


@ENTRIES.add("""
SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1
""")
def dedup_texts(spark, folder):
    return dedup.keep_first(table(spark, folder, "documents"), ["text"], ["doc_id"], digest=True).select("doc_id", "source", "n_chars")


@ENTRIES.add("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def preview_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return cleaning.preview(orders, 20, [F.desc("o_totalprice"), "o_orderkey"])


LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@ENTRIES.add(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {LINE_ORDER}) AS r FROM lineitem) WHERE r = 1
""")
def dedup_keep_first(spark, folder):
    first = dedup.keep_first(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"], LINE_ORDER.split(", "))
    return first.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


# Promotional parts are left out of the entity table, so that their lines are orphans.
def _entities(spark, folder):
    parts = table(spark, folder, "part").filter(F.col("p_type") != "PROMO")
    return parts.select(F.col("p_partkey").alias("item"), "p_name", "p_brand")


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("item"), "l_orderkey", "l_linenumber", "l_quantity")


_ENRICHED_SQL = """
SELECT l_partkey AS item, l_orderkey, l_linenumber, l_quantity, p_name, p_brand
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') ON l_partkey = p_partkey
"""


@ENTRIES.add(_ENRICHED_SQL)
def enrich_left(spark, folder):
    return joins.enrich(_lines(spark, folder), _entities(spark, folder), "item", ["p_name", "p_brand"])


@ENTRIES.add("""
SELECT l_partkey AS item, l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')
""")
def orphan_filter(spark, folder):
    return joins.drop_orphans(_lines(spark, folder), _entities(spark, folder), "item", "p_name")


@ENTRIES.add("SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_name, 'RED (widget|bolt)', 'i')")
def keyword_filter(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return cleaning.find_entities(parts, "p_partkey", "p_name", keyword="RED (widget|bolt)")


@ENTRIES.add("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17")
def id_filter(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return cleaning.find_entities(parts, "p_partkey", "p_name", keyword="ignored", entity_id=17)


@ENTRIES.add("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'gear') ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def first_match(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    matched = cleaning.find_entities(parts, "p_partkey", "p_name", keyword="Gear", literal=True)
    return cleaning.first_row(matched, [F.desc("p_retailprice"), "p_partkey"]).drop("p_retailprice")


@ENTRIES.add("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def roundtrip_csv_parquet(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = shared_folder(spark)
    write_csv(parts, f"{path}/csv")
    write_parquet(read_raw_csv(spark, f"{path}/csv", parts.schema, multiline=False), f"{path}/parquet", ["p_brand"])
    return read_clean(spark, f"{path}/parquet").select(*parts.columns)


@ENTRIES.add("SELECT doc_id, text, lang FROM documents")
def roundtrip_csv_text(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    path = shared_folder(spark)
    write_csv(documents, path)
    return read_raw_csv(spark, path, documents.schema, multiline=True)


@ENTRIES.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def reload_dates(spark, folder):
    text = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    stored = table(spark, folder, "orders").select("o_orderkey", text.alias("day"))
    path = shared_folder(spark)
    write_parquet(stored, path)
    return read_clean(spark, path, date_columns=["day"])


# Raw hotel and review tables in the original layout, made from parts and order lines.
HOTEL_RAW = {
    "Hotel_ID": "concat('1_', CAST(p_partkey AS STRING))",
    "Hotel_Name": "p_name",
    "Hotel_Rank": RANK_TEXT,
    "Hotel_Address": "p_brand",
    "Hotel_Description": "nullif(p_type, 'PROMO')",
    "Total_Score": "concat(' ', CAST(p_size AS STRING), ',5')",
    "Location": "CASE WHEN p_size < 10 THEN 'No information' ELSE CAST(p_size AS STRING) END",
    "Cleanliness": "CASE WHEN p_type = 'SMALL' THEN '1.234,5' ELSE '8,5' END",
    "Service": "CASE WHEN p_type = 'SMALL' THEN NULL ELSE '9.0 ' END",
    "Facilities": "CASE WHEN p_size > 40 THEN '1d' ELSE '7' END",
    "Value_for_money": "CAST(p_size AS STRING)",
    "Comfort_and_room_quality": "CASE WHEN p_size = 3 THEN '' ELSE '1e1' END",
    "comments_count": "CASE WHEN p_size < 5 THEN 'na' ELSE CAST(p_size AS STRING) END",
}


def raw_hotels(spark, folder):
    return table(spark, folder, "part").select(*[F.expr(e).alias(c) for c, e in HOTEL_RAW.items()])


_RAW_HOTELS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in HOTEL_RAW.items()) + " FROM part"
_SCORES_SQL = ", ".join(f"coalesce({_number_sql(c)}, 0) AS {c}" for c in hotel.SCORES)


@ENTRIES.add(f"""
SELECT Hotel_ID, Hotel_Name, Hotel_Address, coalesce(Hotel_Description, '-') AS Hotel_Description, {_SCORES_SQL},
  {_number_sql('comments_count')} AS comments_count,
  coalesce(TRY_CAST(nullif(regexp_extract(Hotel_Rank, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0) AS Hotel_Rank_Num
FROM ({_RAW_HOTELS_SQL})
""")
def clean_entities_job(spark, folder):
    return clean_entities(raw_hotels(spark, folder))


REVIEW_RAW = {
    "num": "ordr",
    "Hotel ID": "CASE WHEN room = 'PROMO' THEN 'unknown' ELSE concat('1_', CAST(item AS STRING)) END",
    "Reviewer ID": "concat('r', CAST(ordr AS STRING))",
    "Reviewer Name": "nullif(segment, 'MACHINERY')",
    "Nationality": "nullif(user, 'NATION_3')",
    "Group Name": "segment",
    "Room Type": "room",
    "Stay Details": "concat('Đã ở ', CAST(nights AS STRING), ' đêm vào Tháng ', CAST(month AS STRING), ' năm 2023')",
    "Review Date": (
        "CASE WHEN month = 2 THEN NULL ELSE concat('Đã nhận xét vào ', CAST(CAST(day(day) AS INT) AS STRING), ' tháng ', "
        "CAST(month AS STRING), ' ', CAST(CAST(year(day) AS INT) AS STRING)) END"
    ),
    "Score": "CASE WHEN nights = 7 THEN 'no information' ELSE concat(CAST(CAST(score AS INT) AS STRING), ',0') END",
    "Body": "CASE WHEN nights = 6 THEN NULL ELSE concat('The ', name, '  was GOOD and ', room, ' !') END",
}
JOB_STOP_WORDS, JOB_WRONG_WORDS = ("the", "and", "!"), ("was", "small")
_RAW_REVIEWS_SQL = "SELECT " + ", ".join(f'{e} AS "{c.replace(" ", "_")}"' for c, e in REVIEW_RAW.items()) + " FROM reviews"


@ENTRIES.add(f"""
WITH {REVIEWS_SQL}, raw AS ({_RAW_REVIEWS_SQL}), hotels AS ({_RAW_HOTELS_SQL}),
t AS (SELECT raw.* EXCLUDE (Score, Review_Date), {_number_sql('Score')} AS Score, h.Hotel_Name,
  TRY_CAST(nullif(regexp_extract(Stay_Details, '{fc.NIGHTS_PATTERN}', 1), '') AS INTEGER) AS Days,
  TRY_CAST(nullif(regexp_extract(Stay_Details, '{fc.MONTH_PATTERN}', 1), '') AS INTEGER) AS Month_Stay,
  CAST(try_strptime(regexp_extract(Review_Date, '{fc.LOCAL_DATE_PATTERN}', 1) || '/' || regexp_extract(Review_Date, '{fc.LOCAL_DATE_PATTERN}', 2)
    || '/' || regexp_extract(Review_Date, '{fc.LOCAL_DATE_PATTERN}', 3), '%d/%m/%Y') AS DATE) AS Review_Date
  FROM raw LEFT JOIN hotels h USING (Hotel_ID) WHERE Reviewer_Name IS NOT NULL AND Body IS NOT NULL),
m AS (SELECT *, avg(Score) OVER (PARTITION BY Hotel_ID) AS mean_score,
  concat_ws('_', Hotel_ID, Reviewer_Name, coalesce(Nationality, 'nan'), coalesce(CAST(Review_Date AS VARCHAR), 'NaT')) AS Review_ID_real FROM t),
u AS (SELECT *, row_number() OVER (PARTITION BY Review_ID_real ORDER BY num, Days, Score NULLS FIRST) AS r FROM m WHERE Hotel_Name IS NOT NULL)
SELECT Review_ID_real, Hotel_ID, Reviewer_Name, Nationality, Group_Name, Room_Type, Score, Body, Hotel_Name, Days, Month_Stay, Review_Date,
  round(mean_score, 6) AS Mean_Reviewer_Score,
  array_to_string(list_filter(string_split_regex(Body, '\\s+'), lambda w: lower(w) NOT IN ({quoted(JOB_STOP_WORDS + JOB_WRONG_WORDS)})), ' ') AS Body_clean
FROM u WHERE r = 1
""")
def clean_reviews_job(spark, folder):
    raw = reviews(spark, folder).select(*[F.expr(e).alias(c) for c, e in REVIEW_RAW.items()])
    cleaned = clean_reviews(
        raw, clean_entities(raw_hotels(spark, folder)), ["num", "Days", F.col("Score").asc_nulls_first()],
        stop_words=JOB_STOP_WORDS, wrong_words=JOB_WRONG_WORDS,
    )
    return rounded(cleaned, 6, "Mean_Reviewer_Score")


# Every fortieth document is followed by a record with two fields, and every fiftieth by an empty line.
BAD = "concat('bad ', CAST(doc_id AS STRING), ',\"two, fields\"')"


def _raw_documents(spark, folder):
    """The documents as raw text files with a header line per file, where texts hold line breaks and quotes."""
    documents = table(spark, folder, "documents").drop("n_chars")
    line = F.to_csv(F.struct(*documents.columns), {"escape": '"', "quoteAll": "true"})
    extra = F.when(F.col("doc_id") % 40 == 0, F.expr(BAD)).when(F.col("doc_id") % 50 == 0, F.lit(""))
    path = shared_folder(spark)
    documents.select(F.concat_ws("\n", line, extra)).write.text(path)
    return read_records(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in documents.columns]), header=False)


@ENTRIES.add("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def csv_records(spark, folder):
    """Raw text files whose fields hold line breaks, each file read by as many tasks as it has splits."""
    return _raw_documents(spark, folder).rows


@ENTRIES.add("SELECT 'number of fields' AS reason, 'bad ' || doc_id || ',\"two, fields\"' AS record FROM documents WHERE doc_id % 40 = 0")
def csv_malformed(spark, folder):
    """The records that don't fit."""
    return _raw_documents(spark, folder).malformed.select("reason", "record")


BUCKETS = 16


@ENTRIES.add(_ENRICHED_SQL)
def enrich_bucketed(spark, folder):
    """The same from tables in buckets, without moving a row."""
    rows, entities = (bucketed.write_bucketed(t(spark, folder), "item", BUCKETS) for t in (_lines, _entities))
    return bucketed.enrich_bucketed(spark, rows, entities, "item", ["p_name", "p_brand"])


@ENTRIES.add("""
SELECT item, l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY item), 6) AS mean
FROM (SELECT l_partkey AS item, * FROM lineitem) WHERE item IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')
""")
def orphans_and_means_bucketed(spark, folder):
    """Lines of known parts with the mean of all lines of their part, from tables in buckets."""
    rows, entities = (bucketed.write_bucketed(t(spark, folder), "item", BUCKETS) for t in (_lines, _entities))
    known = bucketed.write_bucketed(bucketed.drop_orphans_bucketed(spark, rows, entities, "item", "p_name"), "item", BUCKETS)
    return rounded(bucketed.mean_on_rows_bucketed(spark, known, "item", "l_quantity", "mean"), 6, "mean").select("item", "l_orderkey", "l_linenumber", "mean")


@ENTRIES.add(f"""
WITH {REVIEWS_SQL}, raw AS ({_RAW_REVIEWS_SQL}), hotels AS ({_RAW_HOTELS_SQL}),
present AS (SELECT * FROM raw WHERE Reviewer_Name IS NOT NULL AND Body IS NOT NULL),
known AS (SELECT present.* FROM present JOIN hotels USING (Hotel_ID) WHERE Hotel_Name IS NOT NULL),
firsts AS (SELECT DISTINCT Hotel_ID, Reviewer_Name, Nationality, Review_Date FROM known),
counts AS (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM present) AS p, (SELECT count(*) FROM known) AS k, (SELECT count(*) FROM firsts) AS u)
SELECT 'read' AS step, 'rows' AS measure, r AS n FROM counts UNION ALL SELECT 'present', 'rows', p FROM counts UNION ALL SELECT 'known', 'rows', k FROM counts
UNION ALL SELECT 'unique', 'rows', u FROM counts UNION ALL SELECT 'present', 'removed', r - p FROM counts UNION ALL SELECT 'known', 'removed', p - k FROM counts
UNION ALL SELECT 'unique', 'removed', k - u FROM counts
UNION ALL SELECT 'read', 'nulls of Reviewer_Name', count(*) - count(Reviewer_Name) FROM raw UNION ALL SELECT 'read', 'nulls of Body', count(*) - count(Body) FROM raw
UNION ALL SELECT 'read', 'nulls of Hotel_ID', count(*) - count(Hotel_ID) FROM raw
UNION ALL SELECT 'read', 'dirty Score', count(*) FROM raw WHERE lower(trim(coalesce(Score, 'nan'))) IN ({DIRTY})
UNION ALL SELECT 'present', 'unscored', count(*) FROM present WHERE {_number_sql('Score')} IS NULL
UNION ALL SELECT 'known', 'undated', count(*) FROM known WHERE Review_Date IS NULL
""")
def clean_reviews_audit(spark, folder):
    """What the review job drops and finds, counted while its result is written."""
    raw = reviews(spark, folder).select(*[F.expr(e).alias(c) for c, e in REVIEW_RAW.items()])
    audit = Audit()
    cleaned = clean_reviews(
        raw, clean_entities(raw_hotels(spark, folder)), ["num", "Days", F.col("Score").asc_nulls_first()],
        stop_words=JOB_STOP_WORDS, wrong_words=JOB_WRONG_WORDS, audit=audit,
    )
    write_parquet(cleaned, shared_folder(spark))
    return audit.report(spark)
