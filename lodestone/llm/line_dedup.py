"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its words. The edit bound is one word put in, taken out or replaced for lines of EDIT_WORDS words or more, and none for shorter
ones, of which a word is too large a part. Lines within the bound leave equal variants after a deletion from either: the same place
where a word was replaced, one place of the longer line where a word was put in. Each line emits hashed keys: itself (K), its words less
each one (D), and the same with the place (S). Lines meet where K = K, S = S, or K of one = D of the other; the words of lines that so
meet are then compared. Of lines within the bound, all but the earliest go.

Everything is rows that Spark shuffles: a line costs a few rows of hashes, and only distinct lines of which a half also occurs in another
line (one edit leaves the first or the last half alone) emit the neighbourhood. Groups of equal keys are never gathered: their least line
comes of an aggregate that combines before the shuffle, and joins bring it back to the members, one row a key on that side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import cut, give_back, read_table, redealt, sieved, whole_texts, with_id
from .exchange import mix, word_hashes
from .tokens import ragged, slices

#: Fewest words of a line that an edit may join to another.
EDIT_WORDS = 5
#: Lines are hashed so many bytes of text at a time (a longer text alone): their words, variants and what those are made of take some 20 times that.
LINE_BYTES = 1 << 21
ODD, ODD_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Kinds of keys: K the line itself, D the line less a word; S stands under keys of its own.
K, D, S = 0, 1, 2
LINES = "id long, none boolean, hash long, number int, k1 long, k2 long, halves array<long>"
#: The hash of a variant, and four times the rank of its line and its kind.
VARIANTS = "variant long, code long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Lines:
    """The lines of some texts that hold a word: whose they are (``row``), their numbers and sizes in words, and hashes of stretches of them."""

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern(texts, "\n")
        n = np.diff(split.offsets.to_numpy())
        self.strings = split.flatten()
        self.words, begins = word_hashes(self.strings, lower=False)
        sizes = np.diff(begins)
        self.used = np.flatnonzero(sizes > 0)
        self.row = np.repeat(np.arange(len(n)), n)[self.used]
        self.number = ragged(np.zeros(len(n), np.int64), n)[self.used]
        self.size, self.begin = sizes[self.used], begins[:-1][self.used]
        self.place = np.arange(len(self.words)) - np.repeat(begins[:-1], sizes)
        self.kept_sums: dict = {}

    def sums(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of word hash times a power for each place in the line, and the inverse powers that move a stretch to place 0."""
        if h not in self.kept_sums:
            odd = (ODD, ODD_2)[h]
            top = int(self.place.max(initial=0)) + 2
            values = self.words if h == 0 else mix(self.words)
            self.kept_sums[h] = (np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(odd, top)[self.place])]), _powers(pow(odd, -1, 1 << 64), top))
        return self.kept_sums[h]

    def stretch(self, start: np.ndarray, n: np.ndarray, line: np.ndarray, h: int = 0) -> np.ndarray:
        """Hash of the n words from the start-th of each line."""
        total, back = self.sums(h)
        at = self.begin[line] + start
        return (total[at + n] - total[at]) * back[start]

    def whole(self, h: int = 0) -> np.ndarray:
        every = np.arange(len(self.used))
        return mix(self.stretch(np.zeros(len(every), np.int64), self.size, every, h) + self.size.astype(np.uint64))

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of first and last halves of lines that an edit may join. Lines of n and n + 1 words both have those of n // 2 words."""
        out_line, out_key = [], []
        long = np.flatnonzero(self.size >= EDIT_WORDS)
        for k, half in enumerate((self.size // 2, (self.size - 1) // 2)):
            lines = long if k == 0 else long[half[long] != self.size[long] // 2]
            m = half[lines]
            for last, start in enumerate((np.zeros(len(lines), np.int64), self.size[lines] - m)):
                out_line.append(lines)
                out_key.append(mix(self.stretch(start, m, lines) ^ mix((2 * m + last).astype(np.uint64))))
        return np.concatenate(out_line), np.concatenate(out_key)

    def without(self, lines: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, hash of the words less that one) for every word of the given lines."""
        n = self.size[lines]
        line = np.repeat(lines, n)
        place = ragged(np.zeros(len(n), np.int64), n)
        total, back = self.sums(h)
        first, at = self.begin[line], self.begin[line] + place
        before, after = total[at] - total[first], total[first + self.size[line]] - total[at + 1]
        return line, place, mix(before + after * back[np.minimum(1, self.size[line])] + (self.size[line] - 1).astype(np.uint64))


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _lines(batches):
    """LINES of rows (id, none, hash, text)."""
    for batch in batches:
        for part in slices(batch, most=LINE_BYTES):
            lines = Lines(part.column("text"))
            of = pa.array(lines.row)
            line, key = lines.halves()
            order = np.lexsort((key, line))
            ends = np.searchsorted(line[order], np.arange(len(lines.used) + 1)).astype(np.int32)
            halves = pa.ListArray.from_arrays(pa.array(ends), _longs(key[order]))
            columns = [*(part.column(c).take(of) for c in ("id", "none", "hash")), pa.array(lines.number, pa.int32()), _longs(lines.whole()), _longs(lines.whole(1)), halves]
            yield pa.RecordBatch.from_arrays(columns, ["id", "none", "hash", "number", "k1", "k2", "halves"])
        give_back()


def _wanted(part: pa.RecordBatch) -> tuple[Lines, np.ndarray, np.ndarray]:
    """Of rows (text, asked: their lines' numbers and ranks) the lines that are asked for, as places among Lines, and their ranks."""
    lines, asked = Lines(part.column("text")), part.column("asked")
    number, rank = (asked.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
    key = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(asked.offsets.to_numpy())) << 32 | number
    order = np.argsort(key)
    at = np.searchsorted(lines.row << 32 | lines.number, key[order])
    return lines, at, rank[order]


def _variants(batches):
    """VARIANTS of the lines that are asked for."""
    for batch in batches:
        for part in slices(batch, most=LINE_BYTES):
            lines, asked, rank = _wanted(part)
            line, place, rest = lines.without(asked, 0)
            of_line = np.repeat(rank, lines.size[asked])
            with_place = mix(rest + place.astype(np.uint64) + np.uint64(1 << 40))
            code = np.concatenate([4 * x + k for k, x in ((K, rank), (D, of_line), (S, of_line))])
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate([lines.whole()[asked], rest, with_place])), pa.array(code)], ["variant", "code"])
        give_back()


def _texts_of_lines(batches):
    """(rank, line) of the lines that are asked for."""
    for batch in batches:
        for part in slices(batch, most=LINE_BYTES):
            lines, asked, rank = _wanted(part)
            yield pa.RecordBatch.from_arrays([pa.array(rank), lines.strings.take(pa.array(lines.used[asked]))], ["rank", "line"])


def within_one(a: list, b: list) -> bool:
    """Whether one word put in, taken out or replaced, or none, makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _verified(batches):
    """Of rows (rank, other, a, b) those whose lines a and b are within the bound."""
    for batch in batches:
        words = (([w for w in x.encode().split() if w] for x in batch.column(c).to_pylist()) for c in ("a", "b"))
        yield batch.select(["rank", "other"]).filter(pa.array([within_one(a, b) for a, b in zip(*words)], pa.bool_()))


#: Where a line stands, rows without an id last.
PLACE = ["none", "id", "number"]


def line_dedup(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the text of the lines that stay, n_lines, n_dropped and the numbers (from 0) of the dropped lines, for each row of docs.

    A line with a word goes if an earlier line (by doc_id, then number) has the same words or, for lines of EDIT_WORDS words or more, is
    within one word of it; words are told apart by case and the white space between them isn't looked at. What an earlier line is kept
    or dropped for doesn't matter. Lines without a word stay.
    Nulls: a null text is empty; a null doc_id comes after all others and stays null. Repeated rows and ties: lines of one doc_id and
    number are equally early, so neither makes the other go. Very long texts are cut into lines alone, in memory of their own size.
    An empty table gives an empty table, other columns are left behind or, with carry, go along in the struct ``_row``. Equal words are
    told by 128 bits of hash.
    """
    texts = with_id(whole_texts(docs, carry)).withColumn("hash", F.xxhash64("text"))
    row, place = ["id", "none", "hash"], F.struct(*PLACE)
    lines = cut(texts.select(*row, "text").mapInArrow(_lines, LINES))
    first = lines.groupBy("k1", "k2").agg(F.min(F.struct(*PLACE, "hash")).alias("first"))
    halves = lines.select(F.explode("halves").alias("half"), "k1", "k2")
    shared = cut(halves.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("half"))
    with_shared = sieved(halves, "half", shared).where("_hit").join(redealt(shared), "half", "left_semi").select("k1", "k2").distinct()
    # Distinct lines by place: their ranks order as the lines do, and stand for them from here on.
    live = cut(first.join(with_shared, ["k1", "k2"], "left_semi").select("k1", "k2", "first.*").orderBy(*PLACE).withColumn("rank", F.monotonically_increasing_id()))
    asked = live.groupBy(*row).agg(F.collect_list(F.struct("number", "rank")).alias("asked"))
    asked = sieved(texts.select(*row, "text"), "hash", live.select("hash")).where("_hit").drop("_hit").join(asked.hint("shuffle_hash"), row).select("text", "asked")
    variants = asked.mapInArrow(_variants, VARIANTS).select("variant", F.shiftright("code", 2).alias("rank"), F.expr("code & 3").alias("kind"))
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("rank")))
    least = variants.groupBy("variant").agg(of(K).alias("k"), of(D).alias("d"), of(S).alias("s"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo <> hi").drop("lo", "hi")
    other = F.when(F.col("kind") == K, F.col("d")).when(F.col("kind") == D, F.col("k")).otherwise(F.col("s"))
    pairs = cut(variants.join(redealt(least), "variant").select("rank", other.alias("other")).where("other < rank").distinct())
    words = cut(asked.mapInArrow(_texts_of_lines, "rank long, line string").dropDuplicates(["rank"]))
    told = pairs.join(words.withColumnRenamed("line", "a"), "rank").join(words.select(F.col("rank").alias("other"), F.col("line").alias("b")), "other")
    near = told.select("rank", "other", "a", "b").mapInArrow(_verified, "rank long, other long").groupBy("rank").agg(F.min("other").alias("other"))
    earlier = live.select(F.col("rank").alias("other"), place.alias("least"))
    near = live.select("k1", "k2", "rank").join(near, "rank").join(earlier, "other").select("k1", "k2", "least")
    bound = first.select("k1", "k2", F.struct(*[F.col("first")[c].alias(c) for c in PLACE]).alias("least")).unionByName(near).groupBy("k1", "k2").agg(F.min("least").alias("least"))
    gone = cut(lines.join(redealt(bound), ["k1", "k2"]).where(F.col("least") < place).groupBy(*row).agg(F.array_sort(F.collect_set("number")).alias("dropped")))
    told = sieved(texts, "hash", gone.select("hash"))
    whole = told.where("not _hit").withColumn("dropped", F.lit(None).cast("array<int>"))
    return _rebuilt(whole.unionByName(told.where("_hit").join(gone.hint("shuffle_hash"), row, "left")), carry)


def _rebuilt(told: DataFrame, carry: bool) -> DataFrame:
    """Texts less the lines that ``dropped`` numbers."""
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_split", i)), "\n")
    none = F.array().cast("array<int>")
    return told.withColumn("_split", split).select("doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size("_split").cast("long").alias("n_lines"), F.coalesce(F.size("dropped").cast("long"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"), *(["_row"] if carry else []))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))
