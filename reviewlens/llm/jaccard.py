"""N-gram Jaccard join by set-relation skipping.

Documents become sets of word shingles; two sets link when ``100 * intersection >= percent * union``. The
join is exact and never lists the pairs of a group:

1. Equal sets are one class (a class is a third of all rows at worst, and only ever aggregated).
2. A global order of shingles, rare first, gives each set its prefix: linked sets share a prefix shingle.
   Rarity comes from counts in hash buckets over all documents; any order is right, this one keeps shared
   passages out of the prefixes.
3. An inverted index over the prefixes. Lists with the same members are one list.
4. A list's members are compared to one leader. Linked sets need no comparison among each other: their
   answers follow from the leader's. Another leader follows for what is still apart.
5. What is left of a list is compared in blocks, skipping what provably cannot link: sets of the same
   component, of sizes too far apart, or whose sketches differ by more than the largest symmetric
   difference of linked sets. Before shingles are compared, parities in as many classes as shingles are. For each set and each foreign component the closest candidates come
   first; lists where some had to wait get another turn with the new components, so no candidate is lost.

Cases: null or empty texts and texts without words have no shingles and link with nothing. Shorter texts than
``k`` words are one shingle. Repeated ids are separate documents. A null id counts as the largest. Other columns
are ignored. Shingles are compared by 50-bit hashes, sets by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays
from reviewlens.llm.graph import components
from reviewlens.plans.sizing import materialise, small_side

U = np.uint64
BUCKET_BITS = 18
HASH_BITS, LEVEL_BITS = 50, 4  # with 10 bits for the text's place in its slice: one sortable word
SKETCH = [f"s{i}" for i in range(8)]
BLOCK = 512
LEADERS = 2
CLOSEST = 64
KNOWN = 1_000_000


def _hashes(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.utf8(part["text"])
    _, _, hashes, firsts = arrays.words(data, offsets)
    value, owner = arrays.shingles(hashes, firsts, k)
    return value >> U(64 - HASH_BITS), owner


def bucket_levels(docs: DataFrame, k: int) -> np.ndarray:
    """How far each hash bucket's count lies above the mean, on a logarithmic scale of at most 16 steps.

    2**18 buckets whatever the input, counted over all documents; only buckets above the noise reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                value, _ = _hashes(part, k)
                total += np.bincount((value >> U(HASH_BITS - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = materialise(docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    noise = 8 * mean**0.5 + 64
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    for bucket, n in counts.where(F.col("n") > mean + noise).collect():
        levels[bucket] = min(15, int((n - mean) / noise).bit_length())
    return levels


def _sets(part: pa.RecordBatch, k: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in the global order, text by text, and how many come before each text."""
    value, owner = _hashes(part, k)
    level = levels[(value >> U(HASH_BITS - BUCKET_BITS)).astype(np.int64)].astype(U)
    keys = np.sort(owner.astype(U) << U(HASH_BITS + LEVEL_BITS) | level << U(HASH_BITS) | value)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    firsts = np.append(np.searchsorted(keys, np.arange(part.num_rows).astype(U) << U(HASH_BITS + LEVEL_BITS)), len(keys))
    return keys & U((1 << HASH_BITS + LEVEL_BITS) - 1), firsts


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


def _nodes(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U), np.cumsum(arrays.mix(tokens + U(arrays.BASE)))])
    return arrays.mix(sums[firsts[1:]] - sums[firsts[:-1]] + np.diff(firsts).astype(U)).view(np.int64)


def _heads(k: int, percent: int, levels: np.ndarray):
    """Per document: id, size of its set, the set's hash, its prefix in the global order, and its sketch.

    The sketch counts the set's shingles in 128 classes, modulo 16. Each shingle that only one of two sets has
    moves one count by one, so the sum of the counts' circular differences is at most the symmetric difference.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                tokens, firsts = _sets(part, k, levels)
                n = np.diff(firsts)
                length = n - (percent * n + 99) // 100 + 1
                length[100 * n < percent * (n + 1)] = 0  # only an equal set can link
                ends = np.cumsum(length)
                picked = tokens[np.arange(length.sum()) + np.repeat(firsts[:-1] - ends + length, length)]
                spots = (arrays.mix(tokens) >> U(57)).astype(np.int64) + np.repeat(np.arange(len(n)) * 128, n)
                counts = (np.bincount(spots, minlength=128 * len(n)) & 15).astype(np.uint8)
                sketch = (counts[::2] | counts[1::2] << 4).reshape(-1, 64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(n), pa.array(_nodes(tokens, firsts)), _lists(picked, length), *map(pa.array, np.ascontiguousarray(sketch.T))],
                    ["id", "n", "node", "prefix", *SKETCH],
                )

    return heads


def _contents(k: int, levels: np.ndarray):
    """Per document: hash, size and shingles of its set."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                tokens, firsts = _sets(part, k, levels)
                n = np.diff(firsts)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(tokens, firsts)), pa.array(n), _lists(tokens, n)], ["node", "n", "content"])

    return contents


def _parities(k: int, levels: np.ndarray):
    """Per document: hash, size, and parities in a number of classes (a power of two) that is at least twice the size."""

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                tokens, firsts = _sets(part, k, levels)
                n = np.diff(firsts)
                wide = 1 << np.ceil(np.log2(np.maximum(2 * n, 512))).astype(np.int64)
                begin = np.cumsum(wide) - wide
                spots = (arrays.mix(tokens) & np.repeat(wide - 1, n).astype(U)).astype(np.int64) + np.repeat(begin, n)
                bits = (np.bincount(spots, minlength=int(wide.sum())) & 1).astype(np.uint8)
                words = np.packbits(bits).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(tokens, firsts)), pa.array(n), _lists(words, wide // 64)], ["node", "n", "content"])

    return parities


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of the counts' circular differences, row by row."""
    total = np.zeros(len(a), np.int64)
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        one = (x - y) & 15
        total += np.minimum(one, 16 - one).sum(1, dtype=np.int64)
    return total


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return arrays.mix(a.view(U) * U(arrays.BASE) + b.view(U))


def _may_link(percent: int):
    """Pairs ``a, b`` whose sketches do not rule out that they link, from rows with both sides."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = (np.stack([batch[f"{p}{c}"].to_numpy() for c in SKETCH], 1).view(np.uint8) for p in ("", "l"))
            a, b = batch["node"].to_numpy(), batch["lead"].to_numpy()
            near = (100 + percent) * _apart(mine, other) <= (100 - percent) * (batch["n"].to_numpy() + batch["m"].to_numpy())
            both = np.unique(np.sort(np.stack([a[near], b[near]]), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return keep


def _close(percent: int, most: int, known: np.ndarray):
    """Candidate pairs of the lists (or pairs of their blocks) in a task, which come sorted by list and size.

    Every set meets the next, then the next but one, and so on, for all lists at once; a set leaves as soon as
    the sizes are too far apart. Pairs whose hash is ``known`` have been tested. Per set and foreign component at
    most ``most`` others stay, closest first; lists that had more are named in rows of their own.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        get = lambda c: t[c].to_numpy()
        lists, p, q, n, node, label, side = map(get, ("list", "p", "q", "n", "node", "label", "side"))
        sketch = np.stack([get(c) for c in SKETCH], 1).view(np.uint8)
        new = np.concatenate([[True], (lists[1:] != lists[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        group = np.cumsum(new)
        alive, shift, found = np.arange(len(n)), 1, [np.zeros((3, 0), np.int64)]
        while len(alive):
            alive = alive[alive + shift < len(n)]
            other = alive + shift
            alive = alive[(group[alive] == group[other]) & (100 * n[alive] >= percent * n[other])]
            other = alive + shift
            # Side 0: the list is one block. 1 and 2: two blocks, whose inner pairs are dealt with elsewhere.
            i = np.flatnonzero((label[alive] != label[other]) & ((side[alive] == 0) | (side[alive] != side[other])))
            x, y = alive[i], other[i]
            apart = _apart(sketch[x], sketch[y])
            near = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
            found.append(np.stack([x[near], y[near], apart[near]]))
            shift += 1
        x, y, apart = np.concatenate(found, 1)
        code = _pair_hash(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]))
        at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        fresh = known[at] != code if len(known) else np.ones(len(x), bool)
        x, y, apart = x[fresh], y[fresh], apart[fresh]
        order = np.lexsort((apart, label[y], x))
        x, y = x[order], y[order]
        begin = np.concatenate([[True], (x[1:] != x[:-1]) | (label[y[1:]] != label[y[:-1]])]) if len(x) else np.zeros(0, bool)
        place = np.arange(len(x)) - np.maximum.accumulate(np.where(begin, np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)
        keep = place < most
        a, b = node[x[keep]], node[y[keep]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        cut = np.unique(lists[x[~keep]])
        some, rest = pa.nulls(both.shape[1], pa.int64()), pa.nulls(len(cut), pa.int64())
        columns = [pa.concat_arrays([pa.array(both[0]), rest]), pa.concat_arrays([pa.array(both[1]), rest]), pa.concat_arrays([some, pa.array(cut)])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "cut"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = lambda i: tuple(batch[c][i].as_py() for c in ("list", "p", "q"))  # noqa: B023, E731
            # The last list of a batch may go on in the next one.
            lists, p, q = (batch[c].to_numpy() for c in ("list", "p", "q"))
            last = len(lists) - 1
            same = (lists == lists[last]) & (p == p[last]) & (q == q[last]) if len(lists) else np.zeros(0, bool)
            begin = int(np.argmax(same)) if len(lists) else 0
            if len(lists) and (begin or (held and key(0) != tuple(held[-1][c][0].as_py() for c in ("list", "p", "q")))):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return close


class _Join:
    """The state of one join: candidate lists, pairs tested so far, and where the texts come from."""

    def __init__(self, docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int, levels: np.ndarray):
        self.docs, self.classes, self.members, self.k, self.percent, self.levels = docs, classes, members, k, percent, levels
        self.tested = docs.sparkSession.createDataFrame([], "a long, b long, linked boolean")
        self.rest, self.labels = members.withColumn("label", F.col("node")), None

    def sets(self, pairs: DataFrame, make) -> DataFrame:
        """What ``make`` tells of the sets in these pairs, from the texts: ``node, n, content``."""
        nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.classes.select("node", "rep"), "node"))
        wanted = nodes.select(F.col("rep").alias("id")).distinct()
        texts = self.docs.join(small_side(wanted), self.docs["id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
        found = texts.mapInArrow(make(self.k, self.levels), "node long, n long, content array<long>")
        found = found.join(small_side(nodes.select("node")), "node", "left_semi")
        return materialise(found.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("content").alias("content")))

    def both(self, pairs: DataFrame, make) -> DataFrame:
        """The pairs with sizes ``na, nb`` and contents ``ta, tb``."""
        sets = self.sets(pairs, make)
        side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("content").alias(f"t{c}"))
        return pairs.join(side("b"), "b").join(side("a"), "a")

    def verify(self, pairs: DataFrame) -> None:
        """Test the pairs not tested before, by parities and then by their sets."""
        pairs = materialise(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        # Classes of the wider side are put together two by two where the sides differ in width.
        half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
        fitted = lambda c, d: F.when(F.size(c) > F.size(d), half(c)).otherwise(F.col(c))
        apart = F.aggregate(F.zip_with(fitted("ta", "tb"), fitted("tb", "ta"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        close = (100 + self.percent) * apart <= (100 - self.percent) * (F.col("na") + F.col("nb"))
        close = materialise(self.both(pairs, _parities).select("a", "b", close.alias("linked")))
        shared = self.both(close.where("linked").select("a", "b"), _contents).withColumn("i", F.size(F.array_intersect("ta", "tb")))
        linked = 100 * F.col("i") >= self.percent * (F.col("na") + F.col("nb") - F.col("i"))
        self.tested = materialise(self.tested.union(close.where("NOT linked")).union(shared.select("a", "b", linked.alias("linked"))))

    def relabel(self) -> None:
        """The components so far, and the members of lists that may still span more than one."""
        self.labels = components(self.tested.where("linked").select("a", "b"))
        known = small_side(self.labels.select(F.col("id").alias("node"), "component"))
        named = self.members.join(known, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        long = named.where(F.col("size") > BLOCK).groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        self.rest = named.join(small_side(materialise(long.where("low = high").select("list"))), "list", "left_anti")

    def stars(self, turn: int) -> DataFrame:
        """Each list's members beside the list's leader of this turn, where they may link two components."""
        head = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("lead"), F.col("n").alias("m"), F.col("label").alias("its"), *[F.col(c).alias(f"l{c}") for c in SKETCH])
        leaders = self.rest.groupBy("list").agg(F.min(head).alias("l")).select("list", "l.*")
        met = self.rest.join(leaders, "list").where(F.col("label") != F.col("its")).where(100 * F.least("n", "m") >= self.percent * F.greatest("n", "m"))
        return met.drop("list", "size", "label", "its", "h").mapInArrow(_may_link(self.percent), "a long, b long")

    def close(self, rows: DataFrame, most: int) -> DataFrame:
        """Test the candidate pairs of these members' lists, at most ``most`` per set and foreign component; lists with more.

        Up to ``KNOWN`` pairs tested before are sent along, so that they are not found again in every list they share.
        """
        known = np.zeros(0, U)
        if self.tested.count() <= KNOWN:
            pairs = self.tested.select("a", "b").toArrow()
            known = np.sort(_pair_hash(pairs["a"].to_numpy(), pairs["b"].to_numpy()))
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        mine = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks))
        dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
            "list", "node", "n", "label", *SKETCH, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        )
        sorted_ = dealt.repartition("list", "p", "q").sortWithinPartitions("list", "p", "q", "n", "node")
        near = materialise(sorted_.mapInArrow(_close(self.percent, most, known), "a long, b long, cut long"))
        self.verify(near.where("cut IS NULL").select("a", "b"))
        self.relabel()
        return near.where("cut IS NOT NULL").select(F.col("cut").alias("list"))


def near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    levels = bucket_levels(docs, k)
    heads = materialise(docs.mapInArrow(_heads(k, percent, levels), "id long, n long, node long, prefix array<long>" + "".join(f", {c} long" for c in SKETCH)))
    classes = materialise(
        heads.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), *[F.any_value(c).alias(c) for c in SKETCH])
    )
    postings = classes.select("node", F.explode("prefix").alias("token"))
    lists = materialise(
        postings.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"))
        .where("c > 1").groupBy("c", "x").agg(F.min("token").alias("token"))
    )
    members = postings.join(small_side(lists.select("token", F.col("c").alias("size"))), "token").select(F.col("token").alias("list"), "size", "node")
    members = materialise(members.join(classes.select("node", "n", *SKETCH), "node"))
    join = _Join(docs, classes, members, k, percent, levels)
    for turn in range(LEADERS):
        join.verify(join.stars(turn))
        join.relabel()
    # First an eighth of the lists: most candidate pairs share several, and need to be found once.
    eighth = F.pmod(F.xxhash64("list"), F.lit(8)) == 0
    open_ = materialise(join.close(join.rest.where(eighth), 1).union(join.close(join.rest.where(~eighth), 1)).distinct())
    most = 1
    while not open_.isEmpty():
        most *= CLOSEST
        open_ = materialise(join.close(join.rest.join(small_side(open_), "list", "left_semi"), most).distinct())
    labels = join.labels
    named = classes.select("node", "rep").join(labels.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("label", F.coalesce("component", "node"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    result = named.join(smallest, "label").select("node", "least")
    joined = heads.select("id", "n", "node").join(result, "node", "left")
    return joined.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
