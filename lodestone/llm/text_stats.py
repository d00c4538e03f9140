"""Statistics of a text as Spark column expressions, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import WORD, bind, lower_ascii, words_of

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "that", "is", "was", "he", "for", "it", "with", "as", "on", "at", "by", "from", "or", "an", "a",
    "de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "con", "una",
    "le", "les", "des", "et", "à", "est", "du", "dans", "une", "elle", "au",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
]


def _window_hashes(words: Column) -> Column:
    at = lambda i, k: F.get(words, i + k)
    return F.when(
        F.size(words) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(at(i, F.lit(0)), at(i, F.lit(1)), at(i, F.lit(2)), at(i, F.lit(3)), at(i, F.lit(4)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs more than once: sort (hash, place), keep neighbours that agree, add up the union of [place, place + 5)."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = lambda s: F.filter(s, lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False)))
    places = bind(ranked, lambda s: F.array_sort(F.transform(repeated(s), lambda e: e["i"])))
    return bind(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice. The ordered pass runs only where some hash repeats."""
    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0))
    return bind(words, lambda w: bind(_window_hashes(w), found))


def _keyed(docs: DataFrame) -> DataFrame:
    """One row a document with its words and its lines that hold a word."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    return docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})


def with_counts(docs: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) and more, all long; more may
    speak of ``text`` and of its words in ``_words``.

    The counts leave through a generator: filters and projections on them aren't merged into the expressions that make them.
    """
    w, lines = F.col("_words"), F.col("_lines")
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(w),
        **more,
    }
    return _keyed(docs).select(*docs.columns, F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))))


def stop_word_count(words: Column) -> Column:
    return F.size(F.filter(words, lambda x: lower_ascii(x).isin(STOP_WORDS))).cast("long")
