"""Queries on insight per entity: overview, strengths, customer statistics, word counts, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.catalog.base import REVIEWS_SQL, Registry, quoted, reviews, rounded, table, texts
from reviewlens.catalog.text import STOP_WORDS, word_counts_sql
from reviewlens.operators import insight, stats
from reviewlens.operators.insight import ReviewColumns
from reviewlens.plans.sizing import join_lookup

ENTRIES = Registry()
KEYWORD = "Red Widget"
CRITERIA = ("p_size", "p_retailprice", "score", "discount")
COLUMNS = ReviewColumns(
    entity="item", name="name", user="user", group="segment", date="day", nights="nights", month="month", room_type="room",
    score="score", mean_score="mean_score", body="text",
)


# Parts with the mean score and discount of their order lines.
def _entities(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.avg("l_quantity").alias("score"), F.avg("l_discount").alias("discount")
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return parts.join(lines, "p_partkey", "left").fillna({"score": 0.0, "discount": 0.0})


_ENTITIES_SQL = """entities AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, coalesce(score, 0) AS score, coalesce(discount, 0) AS discount
  FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS score, avg(l_discount) AS discount FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)"""


@ENTRIES.add(f"WITH {_ENTITIES_SQL} SELECT p_partkey, p_name, p_brand, round(score, 6) AS score FROM entities WHERE contains(lower(p_name), 'red widget')")
def overview(spark, folder):
    found = insight.overview(_entities(spark, folder), "p_partkey", "p_name", ["p_partkey", "p_name", "p_brand", "score"], keyword=KEYWORD)
    return rounded(found, 6, "score")


_COMPARED_SQL = f"""{_ENTITIES_SQL},
one AS (SELECT * FROM entities WHERE contains(lower(p_name), 'red widget') ORDER BY p_partkey LIMIT 1),
compared AS ({" UNION ALL ".join(
    f"SELECT p_name, '{c}' AS criteria, CAST({c} AS DOUBLE) AS value, (SELECT avg({c}) FROM entities) AS average FROM one" for c in CRITERIA)}),
judged AS (SELECT *, CASE WHEN value > average THEN 'strength' WHEN value < average THEN 'weakness' END AS verdict FROM compared)"""


def _compared(spark, folder):
    return insight.strengths_weaknesses(_entities(spark, folder), "p_partkey", "p_name", CRITERIA, keyword=KEYWORD)


@ENTRIES.add(f"WITH {_COMPARED_SQL} SELECT p_name, criteria, round(value, 6) AS value, round(average, 6) AS average, verdict FROM judged")
def strengths_weaknesses(spark, folder):
    return rounded(_compared(spark, folder), 6, "value", "average")


def _listed_sql(verdict: str) -> str:
    place = f"list_position([{quoted(CRITERIA)}], criteria)"
    return f"coalesce(string_agg(criteria, ',' ORDER BY {place}) FILTER (verdict = '{verdict}'), '')"


@ENTRIES.add(f"WITH {_COMPARED_SQL} SELECT p_name, {_listed_sql('strength')} AS strengths, {_listed_sql('weakness')} AS weaknesses FROM judged GROUP BY p_name")
def strength_lists(spark, folder):
    lists = insight.strength_lists(_compared(spark, folder), "p_name", CRITERIA)
    return lists.select("p_name", F.array_join("strengths", ",").alias("strengths"), F.array_join("weaknesses", ",").alias("weaknesses"))


def _statistics(spark, folder):
    rows = stats.mean_on_rows(reviews(spark, folder), "item", "score", "mean_score")
    return insight.customer_statistics(rows, COLUMNS, keyword=KEYWORD)


_CHOSEN_SQL = f"""WITH {REVIEWS_SQL}, scored AS (SELECT *, avg(score) OVER (PARTITION BY item) AS mean_score FROM reviews),
chosen AS (SELECT * FROM scored WHERE contains(lower(name), 'red widget'))"""


@ENTRIES.add(f"{_CHOSEN_SQL} SELECT user, count(*) AS n FROM chosen GROUP BY user ORDER BY n DESC, user LIMIT 10")
def customer_statistics_users(spark, folder):
    return _statistics(spark, folder)["users"]


@ENTRIES.add(f"{_CHOSEN_SQL} SELECT segment, count(*) AS n FROM chosen GROUP BY segment")
def customer_statistics_groups(spark, folder):
    return _statistics(spark, folder)["groups"]


@ENTRIES.add(f"{_CHOSEN_SQL} SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n FROM chosen GROUP BY 1")
def customer_statistics_trend(spark, folder):
    return _statistics(spark, folder)["trend"]


@ENTRIES.add(f"{_CHOSEN_SQL} SELECT nights, count(*) AS n FROM chosen GROUP BY nights")
def customer_statistics_nights(spark, folder):
    return _statistics(spark, folder)["nights"]


@ENTRIES.add(f"""{_CHOSEN_SQL}, c AS (SELECT month, count(*) AS n FROM chosen GROUP BY month)
SELECT month, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) FULL JOIN c USING (month)""")
def customer_statistics_months(spark, folder):
    return _statistics(spark, folder)["months"]


@ENTRIES.add(f"""{_CHOSEN_SQL}, top AS (SELECT room, count(*) AS n FROM chosen GROUP BY room ORDER BY n DESC, room LIMIT 5)
SELECT room, n, round(n / sum(n) OVER (), 6) AS share FROM top""")
def customer_statistics_room_types(spark, folder):
    return rounded(_statistics(spark, folder)["room_types"], 6, "share")


@ENTRIES.add(f"""{_CHOSEN_SQL},
c AS (SELECT CAST(least(floor(score), 9) AS INTEGER) AS low, count(*) AS n FROM chosen WHERE score BETWEEN 0 AND 10 GROUP BY 1)
SELECT low, low + 1 AS high, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS low FROM range(10)) LEFT JOIN c USING (low)""")
def customer_statistics_scores(spark, folder):
    return _statistics(spark, folder)["score_histogram"]


@ENTRIES.add(f"{_CHOSEN_SQL} SELECT round(avg(mean_score), 6) AS mean_score FROM chosen")
def customer_statistics_mean(spark, folder):
    return rounded(_statistics(spark, folder)["mean_score"], 6, "mean_score")


@ENTRIES.add(word_counts_sql("source = 'src7'", 200))
def word_cloud_entity(spark, folder):
    documents = texts(spark, folder, F.col("source").alias("item"), F.col("source").alias("name"), "text")
    return rounded(insight.word_cloud(documents, COLUMNS, entity_id="src7", stop_words=STOP_WORDS), 6, "weight")


# One row per order line with the review columns and a text: the part's words.
def _described(spark, folder):
    rows = stats.mean_on_rows(reviews(spark, folder), "item", "score", "mean_score")
    return rows.withColumn("text", F.concat_ws(" ", "name", "room"))


@ENTRIES.add(rf"""{_CHOSEN_SQL}, {_COMPARED_SQL},
users AS (SELECT user, count(*) AS n FROM chosen GROUP BY user ORDER BY n DESC, user LIMIT 10),
words AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(name || ' ' || room), ' ')) AS word FROM chosen) GROUP BY word)
SELECT 'strengths' AS section, criteria AS label, round(value, 6) AS value FROM judged
UNION ALL SELECT 'users', user, n FROM users
UNION ALL SELECT 'nights', CAST(nights AS VARCHAR), count(*) FROM chosen GROUP BY nights
UNION ALL SELECT 'words', word, n FROM words
UNION ALL SELECT 'overview', p_name, p_partkey FROM entities WHERE contains(lower(p_name), 'red widget')
UNION ALL SELECT 'groups', segment, n FROM (SELECT segment, count(*) AS n FROM chosen GROUP BY segment ORDER BY n DESC, segment LIMIT 10)
UNION ALL SELECT 'trend', CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR), count(*) FROM chosen GROUP BY 2
UNION ALL SELECT 'months', CAST(m AS VARCHAR), (SELECT count(*) FROM chosen WHERE month = m) FROM (SELECT unnest(range(1, 13)) AS m)
UNION ALL SELECT 'room_types', room, n FROM (SELECT room, count(*) AS n FROM chosen GROUP BY room ORDER BY n DESC, room LIMIT 5)
UNION ALL SELECT 'score_histogram', CAST(low AS VARCHAR), (SELECT count(*) FROM chosen WHERE score BETWEEN 0 AND 10 AND least(floor(score), 9) = low) FROM (SELECT unnest(range(10)) AS low)
UNION ALL SELECT 'mean_score', 'mean', round(avg(mean_score), 6) FROM chosen
""")
def insight_bundle_long(spark, folder):
    made = insight.insight_bundle(
        _entities(spark, folder), _described(spark, folder), COLUMNS, id_col="p_partkey", name_col="p_name",
        overview_columns=["p_partkey", "p_name"], criteria=CRITERIA, keyword=KEYWORD,
    )
    pairs = {
        "overview": ("p_name", "p_partkey"), "strengths_weaknesses": ("criteria", "value"), "score_histogram": ("low", "n"),
        "mean_score": (F.lit("mean").alias("label"), "mean_score"),
    }
    named = {"strengths_weaknesses": "strengths"}
    stacked = insight.long_form({named.get(k, k): made[k].select(*pairs.get(k, made[k].columns[:2])) for k in made})
    return rounded(stacked, 6, "value")


_REPORT = ("score", "p_size", "p_retailprice")


@ENTRIES.add(f"""WITH {REVIEWS_SQL}, joined AS (SELECT reviews.*, p_size, p_retailprice FROM reviews JOIN part ON item = p_partkey)
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std,
    CAST(min({c}) AS DOUBLE) AS min, round_even(quantile_cont({c}, 0.25), 2) AS p25, round_even(quantile_cont({c}, 0.5), 2) AS p50,
    round_even(quantile_cont({c}, 0.75), 2) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM joined""" for c in _REPORT))
def report_tables(spark, folder):
    scores = table(spark, folder, "part").select(F.col("p_partkey").alias("item"), "p_size", "p_retailprice")
    joined = join_lookup(reviews(spark, folder), scores, ["item"], "inner")
    return insight.report_tables(joined, "name", "score", _REPORT)["summary"]
