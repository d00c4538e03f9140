"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import read_table, whole_texts
from .text_stats import STOP_WORDS, stop_word_count, with_counts

#: (rule, numerator, denominator, least, most, words needed before the rule applies). None: no bound on that side.
RULES = [
    ("word_length", "word_chars", "n_words", 1.5, 25.0, 10),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.25, 1),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5, 1),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.002, None, 200),
]
#: Base thresholds: fewest words, and the greatest percentage of words in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def broken(rule: tuple) -> Column:
    """True where the rule's ratio is out of its bounds; an empty denominator breaks nothing."""
    _, top, below, least, most, words = rule
    ratio = F.col(top).cast("double") / F.nullif(F.col(below), F.lit(0))
    out = [ratio < least] if least is not None else []
    out += [ratio > most] if most is not None else []
    return (F.col("n_words") >= words) & F.coalesce(reduce(or_, out), F.lit(False))


def quality_rules(docs: DataFrame, rules: list[tuple] = RULES, carry: bool = False) -> DataFrame:
    """doc_id, text, the counts, ``base_failed``, ``failed_rules`` (names) and ``kept`` for each row of docs.

    Nulls: a null text is empty, so it has no words and fails the base rule; a null doc_id stays null. Repeated rows and ties are
    judged row by row, very long texts whole; an empty table gives an empty table; columns besides doc_id and text are
    left behind or, with carry, go along in the struct ``_row``, so none can clash.
    """
    counted = with_counts(whole_texts(docs, carry), {"n_stop_words": stop_word_count(F.col("_words"))})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull())
    judged = counted.withColumns({"base_failed": base, "failed_rules": names})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i:i+4] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
c AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS}))) AS n_stop_words
  FROM w LEFT JOIN cov ON cov.r = w.r),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_stop_words,
  NOT (base_failed OR (n_words >= 10 AND (word_chars::DOUBLE / n_words < 1.5 OR word_chars::DOUBLE / n_words > 25)) OR (n_words >= 1 AND n_symbols::DOUBLE / n_words > 0.25)
    OR (n_lines > 0 AND n_dup_lines::DOUBLE / n_lines > 0.5) OR (n_words >= 200 AND n_stop_words::DOUBLE / n_words < 0.002)) AS kept
FROM b
"""
