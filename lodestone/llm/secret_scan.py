"""Secret scans in Spark expressions: patterns first, then sliding-window Shannon entropy over candidate strings, less an allow-list.

Places of matches come from cutting the text at the matches: lengths of what lies between, added up. The entropy of a window of
``WINDOW`` characters is log2(WINDOW) - S / WINDOW with S the sum of c*log2(c) over its character counts c; sliding by one character
takes one off a count and adds one to another, and changes S by their terms. The counts go along in a string, a character for each of
ALPHABET and one for all others.
"""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import LOWER, UPPER, bind, read_table, whole_texts

#: kind, pattern, group that is measured, characters it needs. The order breaks ties of a common start.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
WINDOW = 20
#: Matches laid out at a time: what has been laid is copied for each match, so a text's many matches go in blocks.
BLOCK = 256
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = UPPER + LOWER + "0123456789+/_=-"
#: Character class (kind, what a candidate must match): bits of entropy that some window must reach. The first that matches counts.
CLASSES = [
    ("entropy_hex", r"^[0-9A-Fa-f]+$", 3.0), ("entropy_base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.9), ("entropy_lower", r"^(?=.*[0-9])(?=.*[a-z])", 3.7),
    ("entropy_upper", r"^(?=.*[0-9])(?=.*[A-Z])", 3.6), ("entropy_letters", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+$", 4.0),
]
#: Candidates that are never added: UUIDs, dated paths and words joined by hyphens or underscores (letters alone have a class), rulers.
ALLOW = [r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^(?=.*[0-9/_-])[A-Za-z/_-]+[0-9]{0,4}$", r"^[0-9/_=+-]+$"]
#: What is cut out of a candidate, as base spans are, with its length: documented examples and runs of a character.
COVERED = [(r"(?i)example", 7), (r"(.)\1{7}", 8)]


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points; found is the group's text."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def laid(gaps: Column, whole: Column, found: Column) -> Column:
        step = lambda acc, i: bind(
            acc["at"] + F.length(F.get(gaps, i)),
            lambda a: F.struct((a + F.length(F.get(whole, i))).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + F.length(F.get(whole, i))).alias("end"), F.get(found, i).alias("found")))).alias("out")),
        )
        block = lambda k: F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, F.size(whole)) - 1)
        blocks = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"))
        width = lambda i: F.length(F.get(gaps, i)) + F.length(F.get(whole, i))
        sums = F.transform(blocks, lambda k: F.aggregate(block(k), F.lit(0), lambda s, i: s + width(i)))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
        spans = lambda at, k: F.aggregate(block(k), F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return bind(begins, lambda known: F.flatten(F.transform(blocks, lambda k: spans(F.get(known, k), k))))

    find = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    full = bind(F.split(text, pattern, -1), lambda gaps: bind(find(0), lambda whole: bind(find(group), lambda found: laid(gaps, whole, found))))
    return F.when(text.rlike(pattern), full).otherwise(none)


def _term(count: Column) -> Column:
    """c*log2(c) for c of 0 to WINDOW, from a table."""
    return F.get(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)]), count)


def peak_entropy(candidate: Column) -> Column:
    """The greatest entropy in bits of any window of the candidate (at least WINDOW characters of ALPHABET), by incremental counts."""
    slot = lambda x: F.call_function("locate", x, F.lit(ALPHABET)) + 1

    def changed(state: Column, x: Column, by: int) -> Column:
        """The state (counts, S) with one more or less of x."""

        def put(at: Column) -> Column:
            count = lambda counts: F.ascii(F.substring(counts, at, F.lit(1))) - 48
            return bind(count(state["counts"]), lambda c: F.struct(F.overlay(state["counts"], F.char(c + 48 + by), at).alias("counts"), (state["s"] - _term(c) + _term(c + by)).alias("s")))

        return bind(slot(x), put)

    def slid(chars: Column) -> Column:
        none = F.struct(F.lit("0" * (len(ALPHABET) + 1)).alias("counts"), F.lit(0.0).alias("s"))
        first = F.aggregate(F.slice(chars, 1, WINDOW), none, lambda state, x: changed(state, x, 1))

        def step(acc: Column, i: Column) -> Column:  # the window moves from starting at i to starting at i + 1
            moved = bind(changed(acc["state"], F.get(chars, i - 1), -1), lambda state: changed(state, F.get(chars, i + WINDOW - 1), 1))
            return bind(moved, lambda state: F.struct(state.alias("state"), F.least(acc["least"], state["s"]).alias("least")))

        moves = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(F.array().cast("array<int>"))
        least = bind(first, lambda state: F.aggregate(moves, F.struct(state.alias("state"), state["s"].alias("least")), step, lambda acc: acc["least"]))
        return F.lit(math.log2(WINDOW)) - least / WINDOW

    return bind(F.filter(F.split(candidate, ""), lambda x: x != ""), slid)


def _added(text: Column, base: Column) -> Column:
    """Candidates, less what base spans and COVERED take of them, of a class with a window of that much entropy and not of ALLOW."""

    def kind(found: Column) -> Column:
        allowed, name, bits = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("double")
        for p in ALLOW:
            allowed = allowed | found.rlike(p)
        for k, pattern, least in reversed(CLASSES):
            name, bits = F.when(found.rlike(pattern), F.lit(k)).otherwise(name), F.when(found.rlike(pattern), F.lit(least)).otherwise(bits)
        return F.when(~allowed & bits.isNotNull(), F.when(peak_entropy(found) >= bits, name))

    def uncovered(x: Column) -> Column:
        """The candidate with blanks for what is taken."""
        over = F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        blank = lambda acc, b: F.overlay(acc, F.repeat(F.lit(" "), F.least(b["end"], x["end"]) - F.greatest(b["start"], x["start"])), F.greatest(b["start"] - x["start"], F.lit(0)) + 1)
        out = F.when(F.size(over) > 0, F.aggregate(over, x["found"], blank)).otherwise(x["found"])
        for pattern, n in COVERED:
            out = F.regexp_replace(out, pattern, " " * n)
        return out

    def pieces(x: Column) -> Column:
        return bind(uncovered(x), lambda left: F.transform(_matches(left, CANDIDATE, 0), lambda y: F.struct((x["start"] + y["start"]).alias("start"), F.lit(len(BASE)).alias("k"), (x["start"] + y["end"]).alias("end"), kind(y["found"]).alias("kind"))))

    return F.filter(F.flatten(F.transform(_matches(text, CANDIDATE, 0), pieces)), lambda x: x["kind"].isNotNull())


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``base`` and ``added``: arrays of (start, k, end, kind), by start, in code points with the end exclusive.

    Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows are scanned row by row, spans that start
    together are told apart by the order of kinds, very long texts are scanned whole, their spans laid out in blocks, an empty table gives
    an empty table, and other columns are left behind.
    """
    one = lambda k, kind, pattern, group, least: F.transform(
        F.filter(_matches(F.col("text"), pattern, group), lambda x: F.length(x["found"]) >= least),
        lambda x: F.struct(x["start"], F.lit(k).alias("k"), x["end"], F.lit(kind).alias("kind")),
    )
    based = whole_texts(docs).withColumn("base", F.array_sort(F.concat(*[one(k, *b) for k, b in enumerate(BASE)])))
    return based.withColumn("added", F.array_sort(_added(F.col("text"), F.col("base"))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(b[0]) for b in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
