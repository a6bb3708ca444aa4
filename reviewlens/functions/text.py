"""Column functions for review text: tokens, word removal, dictionary replacement, language vote.

A tokeniser is any function from a text column to an ``array<string>`` column, so a user's own
``pandas_udf`` can stand in for the ones below.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.cleaning import strip

Tokeniser = Callable[[Column], Column]

# The letters that make a review worth keeping, basic Latin and everything from À to ỹ.
LETTER_PATTERN = "[A-Za-zÀ-ỹà-ỹ]"

# Runs of two or more word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Words of a word cloud may hold apostrophes and be a single character.
CLOUD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"

# Frequent function words per language, the evidence for the language vote. Own choice.
LANGUAGE_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("aber", "als", "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für",
           "ich", "ist", "mit", "nicht", "sich", "sie", "und", "von", "war", "wie", "wir", "zu"),
    "en": ("and", "are", "as", "at", "be", "but", "by", "for", "from", "have", "he", "in", "is",
           "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with"),
    "es": ("como", "con", "del", "el", "en", "es", "esta", "fue", "los", "las", "más", "muy",
           "no", "para", "pero", "por", "que", "se", "sin", "su", "una", "un", "ya", "sus"),
    "fr": ("au", "aux", "avec", "ce", "dans", "des", "du", "elle", "est", "et", "il", "je",
           "la", "le", "les", "mais", "nous", "ou", "par", "pas", "pour", "qui", "sur", "une"),
    "vi": ("bạn", "cho", "có", "của", "cũng", "được", "khách", "không", "là", "lại", "một",
           "này", "nhân", "như", "nhưng", "phòng", "rất", "rồi", "sẽ", "tôi", "tốt", "và", "với", "viên"),
}


def split_words(text: Column) -> Column:
    """Split on any Unicode white space, without empty pieces."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda word: word != "")


def terms(text: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def counted(tokens: Column) -> Column:
    """Different tokens of one array with their counts, as ``array<struct<term, tf>>``.

    Sorts the array and measures its runs, so a text is counted where it lies, without a shuffle.
    """

    # Arrays that an inner function reads are bound as lambda variables; as plain expressions they
    # would be built again for every element.
    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def runs(ordered: Column) -> Column:
        length = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), length), lambda i: (i == 0) | (i == length) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )

        def measure(start: Column) -> Column:
            return F.transform(
                F.slice(start, 1, F.size(start) - 1),
                lambda at, i: F.struct(F.get(ordered, at).alias("term"), (F.get(start, i + 1) - at).cast("long").alias("tf")),
            )

        return bind(starts, measure)

    return bind(F.array_sort(tokens), runs)


def cloud_words(text: Column) -> Column:
    """Lower-case words for a word cloud: possessive ``'s`` cut off, then no pure numbers."""
    found = F.regexp_extract_all(F.lower(text), F.lit(CLOUD_PATTERN), F.lit(0))
    cut = F.transform(found, lambda word: F.regexp_replace(word, "'s$", ""))
    return F.filter(cut, lambda word: ~word.rlike(r"^\p{N}+$"))


def stripped_tokens(stop_words: Sequence[str]) -> Tokeniser:
    """Tokeniser: punctuation becomes space, then stop words go, with case as written."""

    def tokenise(text: Column) -> Column:
        words = split_words(F.regexp_replace(text, r"\p{Punct}", " "))
        return F.filter(words, lambda word: ~word.isin(*stop_words)) if stop_words else words

    return tokenise


def has_letter(text: Column) -> Column:
    """True where the text has at least one letter; null text has none."""
    return F.coalesce(text.rlike(LETTER_PATTERN), F.lit(False))


def drop_words(text: Column, *word_lists: Sequence[str]) -> Column:
    """Remove listed words, compared in lower case, and rejoin the rest by one space."""
    words = split_words(text)
    banned = sorted({word for words_ in word_lists for word in words_})
    if banned:
        words = F.filter(words, lambda word: ~F.lower(word).isin(*banned))
    return F.array_join(words, " ")


def dictionary_column(pairs: Sequence[tuple[str, str]]) -> Column:
    """Ordered key/value pairs as an array literal; entries with an empty value are left out."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in pairs if v])


def replace_substrings(text: Column, dictionary: Column) -> Column:
    """Replace every key by its value wherever it occurs, one entry after the other.

    Later entries see the result of earlier ones. ``dictionary`` is an ordered
    ``array<struct<key, value>>``.
    """
    return F.aggregate(dictionary, text, lambda done, e: F.replace(done, e["key"], e["value"]))


def replace_tokens(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Replace whole white-space-separated words only."""
    kept = {k: v for k, v in pairs if v}
    if not kept:
        return F.array_join(split_words(text), " ")
    lookup = F.create_map(*[F.lit(part) for pair in kept.items() for part in pair])
    return F.array_join(F.transform(split_words(text), lambda w: F.coalesce(F.try_element_at(lookup, w), w)), " ")


def join_texts(*columns: Column) -> Column:
    """Columns side by side with a space, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _among(words: Sequence[str]) -> Callable[[Column], Column]:
    return lambda token: token.isin(*words)


def language_vote(text: Column, words: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Language whose function words occur most often; ties go to the first name, none gives null.

    Row-local: the word sets are hashed literals, so nothing is exploded, joined or shuffled.
    """
    tokens = terms(text)
    names = sorted(words or LANGUAGE_WORDS)
    table = words or LANGUAGE_WORDS

    def pick(found: Column) -> Column:
        votes = [F.size(F.filter(found, _among(table[lang]))) for lang in names]
        best = F.greatest(*votes) if len(votes) > 1 else votes[0]
        choice = F.when(best <= 0, F.lit(None).cast("string"))
        for lang, vote in zip(names, votes):
            choice = choice.when(vote == best, F.lit(lang))
        return choice

    # One lambda variable holds the tokens, so the text is split once and not once per language.
    return F.element_at(F.transform(F.array(tokens), pick), 1)
