"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlens.llm import arrays, bloom, bpe, decontaminate, epsilon, graph, jaccard, langid, lines, pii, quality, secrets

LONG = "word " * 30_000
ROWS = [
    (1, "The cat sat on the mat today and slept.\nshared line", 7), (2, "the CAT sat on  the mat today and slept.\nShared Line ", None),
    (3, None, 1), (4, "", 2), (5, " \n\t", 3), (6, LONG, 4), (6, LONG, 4), (None, "no id here at all, none", 5), (None, None, None),
    (7, "password = 'abc123XYZ' mail me@example.com\n1234", 6), (7, "another text under the same id", 6),
]
# Names that the operators use themselves.
CLASH = ("id", "n", "node", "key", "label", "score", "spans", "matches", "ids", "line", "size", "row", "pattern", "lang_pred", "n_lines")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, other long")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe(odd, none):
    ids = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS)
    assert set(odd.columns) <= set(back.columns)
    assert pairs(back, "doc_id", F.col("decoded").cast("string")) == sorted(((i, t or "") for i, t, _ in ROWS), key=str)
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    once = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    assert once.columns == back.columns and pairs(once, "doc_id", "ids", "decoded") == pairs(back, "doc_id", "ids", "decoded")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aab ’é\n1.x日", max_size=30), min_size=1, max_size=8))
def test_replay_merges_like_one_word_at_a_time(words):
    vocab = bpe.vocabulary(RANKS)
    raw = [w.encode() for w in words]
    ids, counts = bpe.replay(raw, vocab)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [vocab.plain(w) for w in raw]


def test_unknown_id_fails():
    with pytest.raises(ValueError, match="no token"):
        bpe.vocabulary(RANKS).decode(np.array([1, 99_999_999]))


def test_jaccard(odd, none):
    found = pairs(jaccard.near_copies(odd, k=3, percent=70), "doc_id", "n_shingles", "component_id")
    assert len(found) == len(ROWS)
    by = {}
    for i, n, c in found:
        by.setdefault(i, []).append((n, c))
    assert by[1] == [(9, 1)] and by[2] == [(9, 1)] and by[3] == by[4] == [(0, None)] or by[3] == [(0, 3)]
    assert by[4] == [(0, 4)] and by[5] == [(0, 5)] and by[6] == [(1, 6)] * 2 and sorted(c for _, c in by[7]) == [7, 7]
    assert jaccard.near_copies(none).count() == 0


@pytest.mark.parametrize("leaders, closest, block", [(0, 2, 512), (1, 64, 4)])
def test_jaccard_join_is_exact_however_it_is_searched(spark, monkeypatch, leaders, closest, block):
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "CLOSEST", closest)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    mixed = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):  # near copies around three texts, some just at the threshold
        words = list(base) if i % 3 == 0 else [f"v{i % 3}{j}" for j in range(60)]
        for _ in range(mixed.integers(0, 4)):
            words[mixed.integers(0, 60)] = f"x{i}{mixed.integers(0, 99)}"
        texts.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(59)} for i, t in texts}
    least = dict.fromkeys(sets)
    for i in sets:
        least[i] = i
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[b] > least[a]:
                    least[b], changed = least[a], True
    got = jaccard.near_copies(spark.createDataFrame(texts, "doc_id long, text string"), k=2, percent=80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == least


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_chains_and_hubs(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (12, 11)]
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["id"]: r["component"] for r in got.collect()} == {**dict.fromkeys(range(10, 41), 10), **dict.fromkeys(range(100, 140), 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [], 1), (10, [1.0, 0.01], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (12, [None, 1.0], 1),
        (13, [1.0], 1), (14, [3.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = pairs(epsilon.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)]
    near = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (10, 4, 1, False), (None, 4, 1, False)]
    assert got == sorted([*alone, *near, (13, 1, 13, True), (14, 1, 13, False)], key=str)
    assert epsilon.near_vectors(df.limit(0)).count() == 0


def test_language(odd, none, spark):
    train = [(i, t * 3, lang) for i in range(40) for t, lang in (("the house of the rising sun ", "en"), ("das haus der kleinen dinge ", "de"))]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = langid.identify(odd, model)
    assert got.count() == len(ROWS) and {c for c in odd.columns} <= set(got.columns)
    by = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[3, None] == by[4, ""] == by[5, " \n\t"] == ("und", 0.0) and by[1, ROWS[0][1]][0] == "en"
    assert langid.identify(none, model).count() == 0
    blank = langid.train(none.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.identify(odd, blank).collect()} == {"und"}


def test_quality(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (6, 0), (None, 1), (99, 1), (7, None)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(odd, marks)
        got = quality.score(odd, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert quality.score(none, model).count() == 0
    assert quality.train(none, labels).weights.any() == False  # noqa: E712


def test_secrets(odd, none):
    got = secrets.scan(odd, secrets.train(odd))
    spans = {(r["doc_id"], r["text"]): [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in got.collect()}
    assert spans[7, ROWS[9][1]] == [("assign", 0, 21)] and not any(v for k, v in spans.items() if k[1] != ROWS[9][1])
    assert secrets.scan(none, secrets.train(none)).count() == 0


def test_secrets_of_a_new_form_are_found(spark):
    values = [f"{i * 7919 % 99991:05d}aB{i * 104729 % 99991:05d}xQ{i * 1299709 % 99991:05d}" for i in range(80)]
    seen = [(i, f"some plain words stand here\npassword = {v}\nand more of them") for i, v in enumerate(values[:60])]
    field = secrets.train(spark.createDataFrame(seen, "doc_id long, text string"))
    text = f"plain words again\nleaked {values[70]} in the open\nand an end"
    assert field.spans(text, 0.0) == [(text.index(values[70]), text.index(values[70]) + len(values[70]))]
    assert field.spans("only plain words with version 2.0 and 1999", 0.0) == []


def test_benchmark(odd, none, spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, "short"), (4, None), (None, item), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"before {item} after"), (2, "x " + item.replace("quick", "quack").replace(" ", "\n ") + " y"), (3, "the quick brown fox"), (4, None), (None, item), (5, item[:40]),
    ], "doc_id long, text string").withColumn("matches", F.lit(1))
    got = {r["doc_id"]: [(m["item_id"], m["errors"]) for m in r["matches"]] for r in decontaminate.benchmark_matches(docs, items).collect()}
    assert got == {1: [(1, 0), (2, 0)], 2: [(1, 1), (2, 1)], 3: [], 4: [], None: [(1, 0), (2, 0)], 5: []}
    assert decontaminate.benchmark_matches(odd, items).count() == len(ROWS) and decontaminate.benchmark_matches(none, items).count() == 0
    assert decontaminate.benchmark_matches(odd, items.limit(0)).where(F.size("matches") > 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=20))
def test_bit_parallel_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    assert decontaminate.distance(item.encode(), text.encode(), 99) == min(row)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.sampled_from([1, 2, 3, 8, 11, 16]))
def test_window_hashes_tell_windows_apart(data, size):
    hashes = decontaminate.windows(np.frombuffer(data, np.uint8), size)
    found = [data[i : i + size].lower() for i in range(len(data) - size + 1)]
    assert len(hashes) == max(0, len(found)) and len(set(hashes.tolist())) == len(set(found))


def test_lines(odd, none):
    got = {(r["doc_id"], r["other"]): (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_frequent_lines(odd, least_docs=2).collect()}
    assert got[1, 7] == ("The cat sat on the mat today and slept.", 2, 1) and got[3, 1] == ("", 1, 0) and got[5, 3] == (" \n\t", 2, 0) and got[6, 4] == (LONG, 1, 0)
    assert lines.drop_frequent_lines(none).count() == 0


def test_urls(spark):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow"}
    urls = {
        "http://a.Example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "x://b.com/z#q": ("b.com", "/z", "com/"), "x://b.com": ("b.com", "", None), "no scheme/com/": ("", "", None), None: ("", "", None),
        "x://": ("", "", None), "http://notexample.org/a://b": ("notexample.org", "/a://b", None),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = bloom.split_url(F.col("url"))
    rows = df.select("url", host.alias("h"), path.alias("p")).select("*", bloom.longest_rule(F.col("h"), F.col("p"), rules)[0].alias("r")).collect()
    assert {r["url"]: (r["h"], r["p"], r["r"]) for r in rows} == urls


@pytest.mark.parametrize("shard", [50, 8_000_000])
def test_cascade_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(bloom, "SHARD_KEYS", shard)
    monkeypatch.setattr(bloom, "BITS", 3)  # many false positives, many levels
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("in")).union(spark.sql("SELECT CAST(NULL AS STRING), 0"))
    listed = rows.where("CAST(k AS INT) % 7 = 3").select("k")
    got = bloom.mark_listed(rows, "k", listed.union(listed), rows.select("k"), marked="hit")
    assert got.count() == 3001 and got.where("hit <> coalesce(CAST(k AS INT) % 7 = 3, false)").count() == 0
    assert bloom.mark_listed(rows, "k", listed.limit(0), rows.select("k")).where("listed").count() == 0
    assert bloom.mark_listed(rows.limit(0), "k", listed, rows.select("k")).count() == 0


def test_personal_data(odd, none):
    got = pii.find_personal(odd)
    spans = {(r["doc_id"]): [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got.collect() if r["spans"]}
    assert spans == {7: [("email", 28, 42)]} and got.count() == len(ROWS) and pii.find_personal(none).count() == 0


def test_personal_data_behind_learned_words(spark):
    seeds = [(i, f"please dial mobile +1 (555) 010-{i:04d} or walk") for i in range(20)]
    docs = spark.createDataFrame([*seeds, (99, "please dial mobile 5550109999 or walk"), (100, "order number 5550108888 came")], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_personal(docs).collect()}
    assert spans[99] == [("other", 19, 29)] and spans[100] == [] and all(len(spans[i]) == 1 for i in range(20))


def other_spans(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.find_personal(docs, **more).collect()
    return {r["doc_id"]: [t[s["start"] : s["end"]] for s in sorted(r["spans"], key=lambda x: x["start"]) if s["kind"] == "other"]
            for r in found for i, t in rows if i == r["doc_id"] and t is not None}


def test_personal_data_in_rounds(spark):
    """Numbers found behind one word make another confident, which finds more, and so on for four rounds."""
    rows = [(i, f"dial mobile +1 555 010-{i:04d} now") for i in range(60)]
    chain = ["mobile", "private handset", "second line", "night extension", "last resort"]
    for step, (known, new) in enumerate(zip(chain, chain[1:], strict=False)):
        for j in range(20):
            number = f"77{step}{j:05d}"
            rows += [(1000 + 100 * step + 2 * j, f"call {known} {number} now"), (1001 + 100 * step + 2 * j, f"call {new} {number} now")]
    rows += [(5000, "call last resort 99123456 now"), (5001, "invoice total 99123457 now"), (5002, "the last resort hotel")]
    got = other_spans(spark, rows, threshold=0.45)
    assert got[5000] == ["99123456"] and got[5001] == got[5002] == []
    assert all(len(got[i]) == 1 for i, _ in rows if 1000 <= i < 5000)


def test_personal_data_in_quotes_brackets_and_json(spark):
    rows = [(i, f'{{"name": "x", "contact":"+1 555 010-{i:04d}"}} and more') for i in range(20)]
    rows += [(100, '{"contact":"5550109999"}'), (101, "contact=(5550109998)"), (102, "contact: 5550109997,"), (103, '{"order":"5550109996"}'),
             (104, "y" * 500 + " contact 5550109995"), (105, "contact " + " " * 400 + "5550109994"), (106, "n\u00e9e contact 5550109993")]
    got = other_spans(spark, rows)
    assert {i: got[i] for i in range(100, 107)} == {
        100: ["5550109999"], 101: ["5550109998"], 102: ["5550109997"], 103: [], 104: ["5550109995"], 105: ["5550109994"], 106: ["5550109993"]}


def plain_rounds(rows, threshold):
    """The graph in plain Python: words as strings, every pattern counted by a look at every word."""
    import re

    word = re.compile("[^\\x20\\x09-\\x0D" + re.escape(pii.DELIMITERS) + "]+")
    nodes, total = [], {}
    for row, (_, text) in enumerate(rows):
        places = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(text)]
        for i, (_, _, w) in enumerate(places):
            total[w,] = total.get((w,), 0) + 1
            if i:
                total[places[i - 1][2], w] = total.get((places[i - 1][2], w), 0) + 1
        base = pii.base_spans(text)
        for s, e, seed in [(s, e, True) for _, s, e in base] + [(s, e, False) for s, e in pii._candidates(text, base)]:
            before = [w for _, end, w in places if end <= s]
            patterns = ([tuple(before[-1:])] if before else []) + ([tuple(before[-2:])] if len(before) > 1 else [])
            nodes.append((row, s, e, seed, "".join(text[s:e].lower().split()), patterns))
    trusted, confident = {n[4] for n in nodes if n[3] and n[5]}, set()
    while True:
        hits = {}
        for n in nodes:
            for p in n[5]:
                if n[4] in trusted:
                    hits.setdefault(p, []).append(n[4])
        confident = {p for p, said in hits.items() if len(set(said)) >= pii.LEAST and len(said) >= threshold * total[p]}
        more = trusted | {n[4] for n in nodes if not n[3] and set(n[5]) & confident}
        if more == trusted:
            break
        trusted = more
    return {i: [t[s:e] for r, s, e, seed, _, patterns in nodes if r == row and not seed and set(patterns) & confident] for row, (i, t) in enumerate(rows)}


def test_personal_data_as_a_plain_graph(spark):
    random = np.random.default_rng(11)
    words = ["call", "Mobile", "id", "ref", "the", "fax", "at", "(home)"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(random.integers(1, 8)):
            parts.append(str(random.choice(words)) + str(random.choice([" ", ": ", "=", ' "'])))
            kind = random.integers(0, 4)
            parts.append([f"+44 20 7946 {random.integers(0, 30):04d}", f"{random.integers(0, 60):06d}", "plain", "x@y"][kind] + " ")
        rows.append((i, "".join(parts)))
    added = []
    for threshold in (0.2, 0.4):
        got = other_spans(spark, rows, threshold=threshold)
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in plain_rounds(rows, threshold).items()}
        added.append(sum(map(len, got.values())))
    assert added[0] > added[-1]


def test_lines_of_long_texts(spark):
    """100,000 frequent lines in every text: looked up by halving, not one by one."""
    rows = [(i, "\n".join(f"line number {j}" for j in range(100_000)) + f"\nown {i}\nown {i}") for i in range(3)]
    got = lines.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least_docs=3).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == [(i, f"own {i}\nown {i}", 100_002, 100_000) for i in range(3)]


def test_slices_never_cut_a_text():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = [p["text"].to_pylist() for p in arrays.slices(batch, "text", most_rows=2, most_bytes=16)]
    assert [x for p in parts for x in p] == batch["text"].to_pylist() and all(len(p) <= 2 for p in parts)


def test_stages_keep_the_columns(odd, none, spark, tmp_path):
    docs = odd.drop("n_lines").withColumn("n_chars", F.length("text"))
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "another text under the same id, which is long enough")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= len(ROWS) and stage(spark, docs.limit(0), folder).count() == 0
    near = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(r["doc_id"] for r in near.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 7]


def plain_kneser_ney(texts):
    """Log-probability of a character (the last one) behind three others, by language, in plain Python."""
    found = {lang: {} for lang in texts}
    for lang, many in texts.items():
        for t in many:
            t = "   " + t
            for i in range(3, len(t)):
                found[lang][t[i - 3 : i + 1]] = found[lang].get(t[i - 3 : i + 1], 0) + 1
    levels = {lang: {4: n} for lang, n in found.items()}
    for of in levels.values():
        for order in (3, 2, 1):
            of[order] = {}
            for g in of[order + 1]:
                of[order][g[1:]] = of[order].get(g[1:], 0) + 1
    size = len({g for of in levels.values() for g in of[1]}) + 1

    def p(lang, g):
        if not g:
            return 1 / size
        of = levels[lang][len(g)]
        once, twice = (sum(n == k for n in of.values()) for k in (1, 2))
        d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        near = [n for h, n in of.items() if h[:-1] == g[:-1]]
        if not near:
            return p(lang, g[1:])
        return max(of.get(g, 0) - d, 0) / sum(near) + d * len(near) / sum(near) * p(lang, g[1:])

    return p


@pytest.mark.parametrize("part", [150, 4_000_000])
def test_language_models_keep_all_4_grams(spark, monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    monkeypatch.setattr(langid, "SAMPLE", 5)
    texts = {"de": ["das haus der kleinen dinge", "ein 日本 wort"], "en": ["the house of the rising sun", "once and only once: żółw"]}
    docs = spark.createDataFrame([(i, t, lang) for lang, many in texts.items() for t in many for i in range(20)] + [(2, "xyzzy" * 9, "en")], "doc_id long, text string, lang string")
    kept = docs.where(langid.fold(F.col("doc_id")) != 2).collect()
    counted = {lang: ["".join(c if c.isalpha() else " " for c in r["text"]).replace("  ", " ") for r in kept if r["lang"] == lang] for lang in texts}
    model = langid.train(docs)
    assert (model.parts > 1) == (part == 150)
    p = plain_kneser_ney(counted)
    asked = ["the kleinen żółw", "日本 xq", "plain other words", None]
    found = {}
    schema = arrays.with_fields(spark.createDataFrame([], "text string").schema, size="long", sums="array<double>")
    rows = langid._summed(spark.createDataFrame([(t,) for t in asked], "text string"), model, "text", lambda b, s, n: [b["text"], n, list(s)], schema).collect()
    for r in rows:
        found[r["text"]] = model.entropies(np.array([r["sums"]]), np.array([r["size"]]))[0]
    for t in asked[:-1]:
        for i, lang in enumerate(model.langs):
            want = -sum(np.log(p(lang, ("   " + t)[j : j + 4])) for j in range(len(t))) / len(t)
            assert abs(found[t][i] - want) < 1e-5
    assert {r["lang_pred"] for r in langid.identify(docs.where("text LIKE '%日本%'"), model).collect()} == {"de"}


def test_secret_field_decodes_every_token():
    """Letters alone may be a secret, and leaving out hopeless tokens changes no path of whole texts."""
    random = np.random.default_rng(5)
    field = secrets.Field()
    field.learned = True
    texts = ["key = abcdefghijklmnopqrst and more words", "plain words only", "x", "a1 b2 c3", "token: Zq9 " * 5]
    for turn in range(40):
        field.state, field.moves = random.normal(-0.2, 1, (secrets.WIDTH, 3)), random.normal(0, 1, (3, 3))
        field.forget()
        for text in texts:
            tokens = [m[0] for m in secrets.TOKEN.finditer(text)]
            whole = field.emissions([secrets.features(tokens, i, turn % 2 == 1) for i in range(len(tokens))])
            scores = field.scores(tokens, turn % 2 == 1)
            assert np.allclose(whole, scores)
            tags, live = field.viterbi(whole), set(field.open_tokens(scores).tolist())
            assert all(t == secrets.O for i, t in enumerate(tags) if i not in live)
    field.state[:], field.moves[:] = 0, 0
    field.forget()
    field.state[secrets.number(f"s:{secrets.shape('abcdefghijklmnopqrst')}")] = [-9, 9, -9]
    assert field.spans("key = abcdefghijklmnopqrst and", 2.0) == [(6, 26)]
