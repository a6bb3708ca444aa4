"""Queries on review text: filters, replacement, removal, concatenation, word counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.catalog.base import Registry, quoted, rounded, table, texts
from reviewlens.functions import dictionary
from reviewlens.functions import text as ft
from reviewlens.operators import features, heavy, language, phrases, text
from reviewlens.operators.joins import without_listed
from reviewlens.session import shared_folder
from reviewlens.sources import words
from reviewlens.sources.tables import local_table

ENTRIES = Registry()

# Unicode white space as a class both regex engines read alike.
SPACE = r"[\s\x0b\x85\p{Z}]+"
TERMS_SQL = rf"regexp_extract_all(lower(text), '{ft.TERM_PATTERN}')"
CLOUD_SQL = "regexp_extract_all(lower(text), '" + ft.CLOUD_PATTERN.replace("'", "''") + "')"
WORDS_SQL = rf"list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '')"
ODD_TEXT = "CASE doc_id % 11 WHEN 3 THEN '12 + 3' WHEN 5 THEN 'Привет' WHEN 7 THEN NULL ELSE text END"
# Order matters: the second entry sees what the first one wrote, the empty value is skipped.
DICTIONARY = (("the", "đã"), ("đã", "das"), ("a", "á"), ("en", ""), ("la", "LA"), ("y", "i"))
STOP_WORDS = ft.LANGUAGE_WORDS["en"]
WRONG_WORDS = ("der", "die", "und", "que", "los")


@ENTRIES.add(f"SELECT doc_id FROM documents WHERE regexp_matches({ODD_TEXT}, '{ft.LETTER_PATTERN}')")
def letter_filter(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", F.expr(ODD_TEXT).alias("text"))
    return text.keep_with_letters(documents, "text").select("doc_id")


@ENTRIES.add("SELECT doc_id, lang FROM (SELECT doc_id, CASE WHEN source <> 'src3' THEN lang END AS lang FROM documents) WHERE lang IS NULL OR lang IN ('de', 'en')")
def language_filter(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", "text", F.expr("CASE WHEN source <> 'src3' THEN lang END").alias("lang")
    )
    return text.keep_languages(documents, "text", ["de", "en"], lang="lang").drop("text")


_WORD_ROWS = ", ".join(f"('{lang}', '{word}')" for lang, words in ft.LANGUAGE_WORDS.items() for word in words)
_VOTE_SQL = f"""
WITH words(lang, word) AS (VALUES {_WORD_ROWS}),
tokens AS (SELECT doc_id, unnest({TERMS_SQL}) AS word FROM documents),
votes AS (SELECT doc_id, words.lang, count(*) AS n FROM tokens JOIN words USING (word) GROUP BY ALL),
best AS (SELECT doc_id, lang AS vote, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS r FROM votes)
SELECT d.doc_id, d.lang, vote FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_id)
"""


@ENTRIES.add(_VOTE_SQL)
def language_vote(spark, folder):
    return texts(spark, folder, "doc_id", "lang", "text").withColumn("vote", ft.language_vote(F.col("text"))).drop("text")


@ENTRIES.add(f"SELECT doc_id FROM ({_VOTE_SQL}) WHERE vote IS NULL OR vote IN ('vi', 'en')")
def language_vote_filter(spark, folder):
    documents = texts(spark, folder, "doc_id", "text")
    return text.keep_languages(documents, "text", ["vi", "en"]).select("doc_id")


def _nested_replace() -> str:
    sql = "text"
    for key, value in DICTIONARY:
        if value:
            sql = f"replace({sql}, '{key}', '{value}')"
    return sql


@ENTRIES.add(f"SELECT doc_id, {_nested_replace()} AS text FROM documents")
def normalize_substring(spark, folder):
    pairs = ft.dictionary_column(DICTIONARY)
    return texts(spark, folder, "doc_id", "text").withColumn("text", ft.replace_substrings(F.col("text"), pairs))


# A dictionary of the usual length by a rule: syllables with an ending, of which some occur, some only after an earlier
# entry has written them, and some never.
ENDINGS = (("n", "ñ"), ("ñd", "ND"), ("zq", "q"), ("r", "ř"), ("ře", "RE"))
LONG_DICTIONARY = tuple((c + v + old, c + v + new) for old, new in ENDINGS for c in "bcdfghjklmnpqrstvwxz" for v in "aeiou")[:449]


def _long_replace() -> str:
    sql = "text"
    for key, value in LONG_DICTIONARY:
        sql = f"replace({sql}, '{key}', '{value}')"
    return sql


@ENTRIES.add(f"SELECT doc_id, {_long_replace()} AS text FROM documents")
def normalize_dictionary(spark, folder):
    """A dictionary of 449 entries, applied one after the other."""
    return texts(spark, folder, "doc_id", "text").withColumn("text", dictionary.replace_entries(F.col("text"), LONG_DICTIONARY))


_TOKEN_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DICTIONARY if v)


@ENTRIES.add(f"SELECT doc_id, array_to_string(list_transform({WORDS_SQL}, lambda w: CASE w {_TOKEN_CASE} ELSE w END), ' ') AS text FROM documents")
def normalize_token(spark, folder):
    return texts(spark, folder, "doc_id", "text").withColumn("text", ft.replace_tokens(F.col("text"), DICTIONARY))


_REMOVED_SQL = (
    f"SELECT doc_id, array_to_string(list_filter({WORDS_SQL}, lambda w: lower(w) NOT IN ({quoted(STOP_WORDS + WRONG_WORDS)})), ' ') AS text FROM documents"
)


@ENTRIES.add(_REMOVED_SQL)
def remove_words(spark, folder):
    return texts(spark, folder, "doc_id", "text").withColumn("text", ft.drop_words(F.col("text"), WRONG_WORDS, STOP_WORDS))


# The word table comes from the data: every word of the benchmark items.
@ENTRIES.add(f"""
WITH listed AS (SELECT list(DISTINCT word) AS words FROM (SELECT unnest({TERMS_SQL}) AS word FROM benchmark))
SELECT doc_id, array_to_string(list_filter({WORDS_SQL}, lambda w: NOT list_contains(words, lower(w))), ' ') AS text FROM documents, listed
""")
def remove_words_table(spark, folder):
    words = table(spark, folder, "benchmark").select(F.explode(ft.terms(F.col("text"))).alias("word"))
    return text.remove_listed_words(texts(spark, folder, "doc_id", "text"), ["doc_id"], "text", words)


@ENTRIES.add("SELECT doc_id, concat(coalesce(text, ''), ' ', coalesce(nullif(lang, 'en'), ''), ' ', source) AS content FROM documents")
def concat_text(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", ft.join_texts(F.col("text"), F.expr("nullif(lang, 'en')"), F.col("source")).alias("content"))


@ENTRIES.add("""
WITH d AS (SELECT 0 AS source, p_partkey AS ord, p_name AS key, p_brand AS value FROM part
  UNION ALL SELECT 1, p_partkey, CASE WHEN p_size < 25 THEN p_name ELSE p_type END, p_brand || ' later' FROM part),
m AS (SELECT key, min((source, ord)) AS first, max_by(value, (source, ord)) AS value FROM d GROUP BY key)
SELECT row_number() OVER (ORDER BY first) - 1 AS ord, key, value FROM m
""")
def dict_merge(spark, folder):
    parts = table(spark, folder, "part")
    first = parts.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("key"), F.col("p_brand").alias("value"))
    second = parts.select(
        F.col("p_partkey").alias("ord"), F.expr("CASE WHEN p_size < 25 THEN p_name ELSE p_type END").alias("key"),
        F.concat("p_brand", F.lit(" later")).alias("value"),
    )
    return features.merge_dictionaries([first, second])


@ENTRIES.add("""
WITH n AS (SELECT source, doc_id, text, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS INTEGER) AS part FROM documents)
SELECT source, part, string_agg(text, ' ' ORDER BY doc_id) AS text FROM n GROUP BY source, part
""")
def concat_by_group(spark, folder):
    documents = table(spark, folder, "documents").select("source", "doc_id", "text")
    return text.concat_by_group(documents, "source", "text", ["doc_id"], part_rows=20)


@ENTRIES.add("""
WITH n AS (SELECT source, doc_id, text, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) - strlen(text) - 1 AS place FROM documents)
SELECT source, CAST(place // 30000 AS INTEGER) AS part, string_agg(text, ' ' ORDER BY doc_id) AS text FROM n GROUP BY source, place // 30000
""")
def concat_by_bytes(spark, folder):
    documents = table(spark, folder, "documents").select("source", "doc_id", "text")
    return text.concat_by_group(documents, "source", "text", ["doc_id"], part_bytes=30_000)


@ENTRIES.add("SELECT source, 0 AS part, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY source")
def concat_whole_groups(spark, folder):
    documents = table(spark, folder, "documents").select("source", "doc_id", "text")
    return text.concat_by_group(documents, "source", "text", ["doc_id"])


def word_counts_sql(where: str, n: int) -> str:
    """SQL of the word-cloud counts over the documents that meet a condition."""
    return rf"""
WITH t AS (SELECT unnest({CLOUD_SQL}) AS word FROM documents WHERE {where}),
s AS (SELECT regexp_replace(word, '''s$', '') AS word FROM t), w AS (SELECT word FROM s WHERE NOT regexp_matches(word, '^\p{{N}}+$')),
c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({quoted(STOP_WORDS)}) GROUP BY word),
m AS (SELECT CASE WHEN c.word LIKE '%s' AND c.word NOT LIKE '%ss' AND s.word IS NOT NULL THEN s.word ELSE c.word END AS word, c.n
  FROM c LEFT JOIN c s ON s.word = left(c.word, -1)),
top AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY word ORDER BY n DESC, word LIMIT {n})
SELECT word, n, round(n / max(n) OVER (), 6) AS weight FROM top"""


@ENTRIES.add(word_counts_sql("true", 200))
def word_freq(spark, folder):
    counts = text.word_frequencies(texts(spark, folder, "text"), "text", STOP_WORDS, 200)
    return rounded(counts, 6, "weight")


@ENTRIES.add(f"""
SELECT token, count(*) AS n FROM (SELECT unnest(list_transform({WORDS_SQL}, lambda w: lower(w))) AS token FROM documents)
WHERE token NOT IN ({quoted(STOP_WORDS)}) GROUP BY token
""")
def anti_membership(spark, folder):
    tokens = texts(spark, folder, "text").select(F.explode(ft.split_words(F.lower("text"))).alias("token"))
    words = local_table(spark, [(w,) for w in STOP_WORDS], "word string")
    return without_listed(tokens, "token", words).groupBy("token").agg(F.count("*").alias("n"))


# Word files as the table of parts gives them: the first line of a name counts, its last brand stands.
@ENTRIES.add("""
WITH o AS (SELECT p_name, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part)
SELECT min(ord) AS ord, p_name AS key, arg_max(p_brand, ord) AS value FROM o GROUP BY p_name
""")
def dictionary_file(spark, folder):
    lines = table(spark, folder, "part").orderBy("p_partkey").select(F.concat_ws("\t", "p_name", "p_brand").alias("value"))
    path = shared_folder(spark)
    lines.write.text(path)  # as many files as the sorted table has ranges, named in their order
    return words.read_dictionary(spark, path)


@ENTRIES.add("SELECT DISTINCT trim(p_type) AS word FROM part WHERE trim(p_type) <> ''")
def word_file(spark, folder):
    lines = table(spark, folder, "part").select(F.explode(F.array(F.concat(F.lit(" "), "p_type", F.lit("\t")), F.lit(""), F.lit("  "))))
    path = shared_folder(spark)
    lines.write.text(path)
    return words.read_words(spark, path)


_GRAMS_SQL = f"""
tokens AS (SELECT doc_id, unnest({TERMS_SQL}) AS w, generate_subscripts({TERMS_SQL}, 1) AS i FROM documents),
grams AS (SELECT w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
singles AS (SELECT a AS w, count(*) AS n FROM grams GROUP BY a),
pairs AS (SELECT a, b, count(*) AS n FROM grams WHERE b IS NOT NULL AND NOT contains(a || b, '_') GROUP BY a, b HAVING count(*) >= {phrases.LEAST_COUNT}),
two AS (SELECT a, b, p.n, CAST(p.n AS DOUBLE) * (SELECT sum(n) FROM singles) / (CAST(x.n AS DOUBLE) * y.n) AS score
  FROM pairs p JOIN singles x ON a = x.w JOIN singles y ON b = y.w WHERE score >= {phrases.LEAST_SCORE}),
triples AS (SELECT a, b, c, count(*) AS n FROM grams WHERE c IS NOT NULL GROUP BY a, b, c HAVING count(*) >= {phrases.LEAST_COUNT}),
scored AS (SELECT t.a, t.b, t.c, t.n, CAST(t.n AS DOUBLE) * (SELECT sum(n) FROM singles) / (CAST(x.n AS DOUBLE) * m.n) AS score
  FROM triples t JOIN two x ON t.a = x.a AND t.b = x.b JOIN two y ON t.b = y.a AND t.c = y.b JOIN singles m ON t.c = m.w),
three AS (SELECT * FROM scored WHERE score >= {phrases.LEAST_SCORE})"""


@ENTRIES.add(f"""WITH {_GRAMS_SQL}
SELECT w AS phrase, 1 AS words, n, CAST(NULL AS DOUBLE) AS score FROM singles
UNION ALL SELECT a || '_' || b, 2, n, round(score, 6) FROM two UNION ALL SELECT a || '_' || b || '_' || c, 3, n, round(score, 6) FROM three
""")
def phrase_lexicon(spark, folder):
    """Words and compound words of the corpus with their association scores."""
    return rounded(phrases.learn_phrases(texts(spark, folder, "text"), "text"), 6, "score")


@ENTRIES.add()
def compound_words(spark, folder):
    """Every text as words and learned compounds."""
    documents = texts(spark, folder, "doc_id", "text").select("doc_id", ft.terms(F.col("text")).alias("tokens"))
    lexicon = phrases.learn_phrases(documents, "tokens", lambda tokens: tokens)
    return phrases.compound_texts(documents, "tokens", lexicon).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t.contains("_"))).alias("n_compounds"),
        F.array_join("tokens", " ").alias("text"))


_PIECES_SQL = rf"""
pieces AS (SELECT doc_id, lang, string_split(' ' || regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g') || ' ', '') AS c FROM documents),
grams AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM pieces),
tallied AS (SELECT doc_id, lang, gram, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, gram, sum(n) AS n FROM tallied WHERE lang IS NOT NULL AND doc_id % 4 <> 2 GROUP BY ALL),
profiles AS (SELECT lang, gram, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS INTEGER) AS rank FROM totals QUALIFY rank < {language.MOST})"""


def _profiles(documents):
    return language.learn_profiles(documents.where("doc_id % 4 <> 2"), "text", "lang")


@ENTRIES.add(f"WITH {_PIECES_SQL} SELECT lang, gram, rank FROM profiles")
def language_profiles(spark, folder):
    """The most frequent character pieces of each language, three quarters of the documents being labelled."""
    return _profiles(texts(spark, folder, "doc_id", "lang", "text"))


@ENTRIES.add(f"""WITH {_PIECES_SQL},
placed AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS place FROM tallied QUALIFY place < {language.MOST}),
saved AS (SELECT doc_id, p.lang, sum({language.MOST} - abs(place - rank)) AS saved FROM placed JOIN profiles p USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, lang FROM saved QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY saved DESC, lang) = 1)
SELECT d.doc_id, d.lang, best.lang AS guess FROM documents d LEFT JOIN best USING (doc_id)
""")
def language_by_profile(spark, folder):
    """The language of every document by its character pieces."""
    documents = texts(spark, folder, "doc_id", "lang", "text")
    guesses = language.nearest_language(documents, ["doc_id"], "text", _profiles(documents), "guess")
    return documents.select("doc_id", "lang").join(guesses, "doc_id")


@ENTRIES.add(word_counts_sql("true", 200))
def word_freq_heavy(spark, folder):
    """The same as ``word_freq``, counting only words that can be among the first."""
    words = texts(spark, folder, "text").select(F.filter(ft.cloud_words(F.col("text")), lambda w: ~w.isin(*STOP_WORDS)).alias("words"))
    return rounded(heavy.heavy_frequencies(words, "words", 200), 6, "weight")
