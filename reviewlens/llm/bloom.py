"""URL filters by a Bloom filter cascade: exact membership of every key of a known universe, without joins.

Level 1 holds the listed keys. Level 2 holds the universe's other keys that level 1 lets through, level 3 the
listed keys that level 2 lets through, and so on until nothing is let through wrongly. A key of the universe is
listed exactly if the first level that turns it away has an even number.

Everything is DataFrame functions. Filters are arrays of 64-bit words, built by bitwise aggregation per word
and handed to the pages as scalar subqueries. Keys are dealt into shards by hash so that no filter exceeds
``SHARD_KEYS * BITS / 8`` bytes (12 MB) on average however long the list; the pages of a shard meet only its filters.

Cases: null keys are never listed and belong to no universe; an empty list lists nothing, an empty universe asks
nothing; repeated keys count once; keys outside the universe may be answered wrongly (give the whole universe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.sizing import materialise

BITS, HASHES = 12, 4
SHARD_KEYS = 8_000_000
MOST_LEVELS = 40


def _word_and_bit(key: Column, level: int, i: int, words: int) -> tuple[Column, Column]:
    code = F.xxhash64(key, F.lit(1000 * level + i))
    return F.pmod(F.shiftright(code, 6), F.lit(words)), F.pmod(code, F.lit(64)).cast("int")


def _bits(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row: the filter's words in order, those without a bit included."""
    pairs = [F.struct(*(c.alias(n) for c, n in zip(_word_and_bit(F.col("key"), level, i, words), "wb", strict=True))) for i in range(HASHES)]
    set_ = keys.select(F.explode(F.array(*pairs)).alias("p")).select(F.col("p.w").alias("w"), F.expr("shiftleft(1L, p.b)").alias("v"))
    filled = set_.groupBy("w").agg(F.bit_or("v").alias("v"))
    empty = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    whole = empty.union(filled).groupBy("w").agg(F.bit_or("v").alias("v"))
    ordered = whole.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: x["v"]).alias("words"))


def _passes(key: Column, words: Column, level: int, size: int) -> Column:
    """Whether a filter lets a key through."""
    tests = []
    for i in range(HASHES):
        word, bit = _word_and_bit(key, level, i, size)
        tests.append(F.getbit(F.get(words, word.cast("int")), bit) == 1)
    return tests[0] & tests[1] & tests[2] & tests[3]


class Cascade:
    """The levels of one shard."""

    def __init__(self, listed: DataFrame, others: DataFrame):
        self.levels: list[tuple[DataFrame, int]] = []
        inside, outside = listed, others
        while len(self.levels) < MOST_LEVELS:
            count = inside.count()
            if not count:
                break
            size = max(1, -(-count * BITS // 64))
            level = len(self.levels) + 1
            words = materialise(_bits(inside, level, size))
            self.levels.append((words, size))
            inside, outside = materialise(outside.where(_passes(F.col("key"), words.scalar(), level, size))), inside
        else:
            raise ValueError("the cascade does not end; do list and universe hold a key that is both in and out?")

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)  # let through by the last level
        for level in range(len(self.levels), 0, -1):
            words, size = self.levels[level - 1]
            answer = F.when(~_passes(key, words.scalar(), level, size), F.lit(level % 2 == 0)).otherwise(answer)
        return answer


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, universe: DataFrame, *, marked: str = "listed") -> DataFrame:
    """``rows`` with ``marked``: whether ``key`` is among the single column of ``listed``.

    ``universe`` holds every key that occurs in ``rows`` (single column; it may hold more, also listed keys).
    """
    name = listed.columns[0], universe.columns[0]
    inside = listed.select(F.col(f"`{name[0]}`").alias("key")).where("key IS NOT NULL").select("key", F.lit(1).alias("in"))
    around = universe.select(F.col(f"`{name[1]}`").alias("key")).where("key IS NOT NULL").select("key", F.lit(0).alias("in"))
    keys = materialise(inside.union(around).groupBy("key").agg(F.max("in").alias("in")))
    shards = max(1, -(-keys.where("in = 1").count() // SHARD_KEYS))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(shards))
    out = None
    for s in range(shards):
        mine = keys if shards == 1 else keys.where(shard(F.col("key")) == s)
        cascade = Cascade(mine.where("in = 1").select("key"), mine.where("in = 0").select("key"))
        of = rows if shards == 1 else rows.where(F.coalesce(shard(F.col(f"`{key}`")), F.lit(0)) == s)
        part = of.withColumn(marked, F.coalesce(cascade.lists(F.col(f"`{key}`")) & F.col(f"`{key}`").isNotNull(), F.lit(False)))
        out = part if out is None else out.union(part)
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty without ``://`` or url."""
    at = F.locate("://", url)
    after = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.coalesce(at, F.lit(0)) > 0
    return F.when(found, lower).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null without one.

    A rule is a host, a slash and the beginning of a path; it fits its host and that host's subdomains. The one
    with the longest text wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=len):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict
