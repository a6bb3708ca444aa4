"""Line dedup: lines found in many documents are dropped everywhere.

Lines are exploded as 128-bit hashes of their keys, once per document; hashes are counted by document and the
frequent ones joined back to the documents that have them. A line in every document is aggregated before the
shuffle; the frequent ones are broadcast if they measure small, else Spark can split the join. Texts take part only in the last
join and are reassembled by position inside their row, each line being looked up in the row's sorted frequent hashes.

Cases: a null or empty text is one empty line; the key of a line of white space is empty and never dropped
(``least_length``); repeated document ids count as one document for the threshold (the lines of each row are
looked up by id); rows with a null id count as one document. All other columns pass unchanged, but for ones named
like the two that are added. A text whose lines are all dropped becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import materialise, small_side

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """What lines are compared by."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(line: Column, least_length: int) -> Column:
    key = line_key(line)
    code = F.struct(F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g"))
    return F.when(F.char_length(key) >= least_length, code)


def frequent_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_docs: int = 10, least_length: int = 1) -> DataFrame:
    """Per document id the sorted hashes of its frequent lines: ``id, dropped array<struct<h, g>>``, only ids that have any."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: _hash(x, least_length))
    # Repeats inside a row go with all others: array_distinct would compare every pair of a row's hashes.
    once = materialise(docs.select(F.col(id).alias("id"), F.explode(F.filter(lines, F.isnotnull)).alias("line")).select("id", "line.*").distinct())
    frequent = materialise(once.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("h", "g"))
    found = once.join(small_side(frequent), ["h", "g"])
    return found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("h", "g"))).alias("dropped"))


def _listed(dropped: Column, key: Column) -> Column:
    """Whether a sorted array holds a key, by halving: a row may have very many lines and very many frequent ones."""
    steps = F.transform(F.sequence(F.length(F.bin(F.size(dropped))) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def search(key: Column) -> Column:
        at = F.aggregate(steps, F.lit(0), lambda at, n: F.when((at + n <= F.size(dropped)) & (F.get(dropped, at + n - 1) < key), at + n).otherwise(at))
        return F.coalesce(F.get(dropped, at) == key, F.lit(False))

    # Bound as a lambda variable, so that a line is hashed once.
    return F.element_at(F.transform(F.array(key), search), 1)


def drop_frequent_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_docs: int = 10, least_length: int = 1) -> DataFrame:
    """``docs`` with frequent lines cut from ``text``, and ``n_lines`` and ``n_dropped`` added."""
    listed = frequent_lines(docs, id=id, text=text, least_docs=least_docs, least_length=least_length)
    listed = listed.select(F.col("id").alias("__id"), F.col("dropped").alias("__dropped"))
    joined = docs.join(listed, docs[id].eqNullSafe(listed["__id"]), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    kept = F.filter(F.col("__lines"), lambda x: ~_listed(F.col("__dropped"), _hash(x, least_length)))
    cut = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__dropped").isNull(), F.col("__lines")).otherwise(kept))
    others = [F.col(f"`{c}`") if c != text else F.array_join("__kept", "\n").alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*others, F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"))
