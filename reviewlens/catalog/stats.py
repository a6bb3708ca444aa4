"""Queries on summaries, frequencies, trends, histograms and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.catalog.base import REVIEWS_SQL, Registry, reviews, rounded, table
from reviewlens.operators import joins, sketches, stats
from reviewlens.plans.sizing import materialise
from reviewlens.session import shared_folder

ENTRIES = Registry()
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _describe_sql(columns, digits: int, rounding: str) -> str:
    parts = []
    for c in columns:
        q = ", ".join(f"{rounding}(quantile_cont({c}, {p}), {digits}) AS {n}" for n, p in stats.QUARTILES.items())
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, {rounding}(avg({c}), {digits}) AS mean, """
            f"{rounding}(stddev_samp({c}), {digits}) AS std, {rounding}(min({c}), {digits}) AS min, {q}, "
            f"{rounding}(max({c}), {digits}) AS max FROM lineitem"
        )
    return " UNION ALL ".join(parts)


@ENTRIES.add(_describe_sql(["l_quantity"], 6, "round"))
def describe_score(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(stats.describe(lines, ["l_quantity"]), 6, "mean", "std", "min", "p25", "p50", "p75", "max")


@ENTRIES.add(_describe_sql(MEASURES, 2, "round_even"))
def describe_many(spark, folder):
    return stats.describe(table(spark, folder, "lineitem"), MEASURES, digits=2)


@ENTRIES.add(f"""
WITH {REVIEWS_SQL} SELECT user, count(DISTINCT item) AS n FROM reviews GROUP BY user ORDER BY n DESC, user LIMIT 10
""")
def distinct_per_group(spark, folder):
    return stats.distinct_per_group(reviews(spark, folder), "user", "item", 10)


@ENTRIES.add("SELECT p_size, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_size")
def distinct_per_rank(spark, folder):
    return stats.distinct_per_group(table(spark, folder, "part"), "p_size", "p_partkey")


@ENTRIES.add("SELECT l_partkey, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_partkey")
def mean_per_entity(spark, folder):
    return rounded(stats.mean_per_entity(table(spark, folder, "lineitem"), "l_partkey", "l_quantity"), 6, "mean")


@ENTRIES.add(f"WITH {REVIEWS_SQL} SELECT user, count(*) AS n FROM reviews GROUP BY user ORDER BY n DESC, user LIMIT 10")
def top_categories(spark, folder):
    return stats.top_categories(reviews(spark, folder), "user", 10)


@ENTRIES.add("""
SELECT nullif(l_returnflag, 'A') AS flag, count(*) AS n FROM lineitem WHERE nullif(l_returnflag, 'A') IS NOT NULL GROUP BY 1
""")
def all_categories(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.expr("nullif(l_returnflag, 'A')").alias("flag"))
    return stats.top_categories(lines, "flag")


@ENTRIES.add("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity")
def freq_by_key(spark, folder):
    return stats.frequencies_in_key_order(table(spark, folder, "lineitem"), "l_quantity")


@ENTRIES.add("""
WITH top AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5)
SELECT p_brand, n, round(n / sum(n) OVER (), 6) AS share FROM top
""")
def category_share(spark, folder):
    return rounded(stats.category_share(table(spark, folder, "part"), "p_brand", 5), 6, "share")


@ENTRIES.add("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem")
def system_average(spark, folder):
    means = stats.averages(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"])
    return rounded(means, 6, "l_quantity", "l_discount")


@ENTRIES.add(f"""
WITH {REVIEWS_SQL} SELECT count(*) AS rows, count(DISTINCT name) AS names, round(avg(score), 6) AS mean_score FROM reviews
""")
def report_totals(spark, folder):
    return rounded(stats.report_totals(reviews(spark, folder), "name", "score"), 6, "mean_score")


@ENTRIES.add("SELECT count(*) FILTER (lang NOT IN ('de', 'en')) AS flagged FROM documents")
def flag_count(spark, folder):
    return stats.flag_count(table(spark, folder, "documents"), ~F.col("lang").isin("de", "en"))


@ENTRIES.add("SELECT count(*) AS rows FROM orders")
def row_count(spark, folder):
    return stats.row_count(table(spark, folder, "orders"))


@ENTRIES.add("SELECT DISTINCT p_name, p_type FROM part")
def distinct_sorted(spark, folder):
    return stats.distinct_sorted(table(spark, folder, "part"), ["p_name", "p_type"])


@ENTRIES.add("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders
WHERE o_orderstatus <> 'P' GROUP BY 1
""")
def monthly_trend(spark, folder):
    dated = table(spark, folder, "orders").select(F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END").alias("day"))
    return stats.monthly_trend(dated, "day")


@ENTRIES.add("""
WITH c AS (SELECT CAST(month(ts) AS INTEGER) + (CASE WHEN event_type = 'error' THEN 12 ELSE 0 END) AS month, count(*) AS n
  FROM events GROUP BY 1)
SELECT month, coalesce(n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) FULL JOIN c USING (month)
""")
def month_zero_fill(spark, folder):
    month = F.month("ts") + F.when(F.col("event_type") == "error", 12).otherwise(0)
    counts = stats.frequencies(table(spark, folder, "events").select(month.alias("month")), "month")
    return joins.zero_fill(counts, "month", "n", 1, 12)


@ENTRIES.add("""
WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, coalesce(n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) LEFT JOIN c USING (bin), b
""")
def hist_equal_width(spark, folder):
    return rounded(stats.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 20), 4, "low", "high")


@ENTRIES.add("""
WITH c AS (SELECT CAST(least(floor(l_quantity), 9) AS INTEGER) AS low, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 10 GROUP BY 1)
SELECT low, low + 1 AS high, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS low FROM range(10)) LEFT JOIN c USING (low)
""")
def hist_integer_edges(spark, folder):
    return stats.histogram_integer_edges(table(spark, folder, "lineitem"), "l_quantity", 0, 10)


@ENTRIES.add("""
WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_suppkey END AS entity, l_quantity FROM lineitem)
SELECT *, CASE WHEN entity IS NOT NULL THEN round(avg(l_quantity) OVER (PARTITION BY entity), 6) END AS entity_mean FROM t
""")
def group_mean_on_row(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.expr("CASE WHEN l_returnflag <> 'A' THEN l_suppkey END").alias("entity"), "l_quantity"
    )
    return rounded(stats.mean_on_rows(lines, "entity", "l_quantity", "entity_mean"), 6, "entity_mean")


@ENTRIES.add("""
SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max, true AS quantiles_within, true AS distinct_within FROM lineitem GROUP BY l_returnflag
""")
def sketch_report(spark, folder):
    """Statistics per flag from summaries per flag and day: half of the rows first, the other half appended later.

    Of quantiles and numbers of different parts it says whether they are within their bounds of the exact ones.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_partkey")
    path, group = shared_folder(spark), ["l_returnflag"]
    for half in (0, 1):
        sketches.append(lines.where(F.col("l_orderkey") % 2 == half), path, group, "l_shipdate", "l_extendedprice", "l_partkey")
    made = materialise(sketches.report(spark.read.parquet(path), group, stats.QUARTILES))
    # One row per flag.
    met = lines.join(F.broadcast(made), group)
    error = sketches.rank_error()
    within = [
        (F.count_if(F.col("l_extendedprice") < F.col(c)) / F.count("*") <= p + error) & (F.count_if(F.col("l_extendedprice") <= F.col(c)) / F.count("*") >= p - error)
        for c, p in stats.QUARTILES.items()
    ]
    parts = F.countDistinct("l_partkey")
    checked = met.groupBy(*group).agg(
        (within[0] & within[1] & within[2]).alias("quantiles_within"), (F.abs(F.any_value("distinct") - parts) <= 0.1 * parts).alias("distinct_within"))
    return rounded(made.join(checked, group), 4, "mean", "std").select(*group, "count", "mean", "std", "min", "max", "quantiles_within", "distinct_within")
