"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, found without a miss, and SimHash links.

Candidates by prefix filter: two sets that similar share shingles among the first fifth (and one) of each, in any order that is the same
for all, and how many at least follows from their sizes. The order has shingles that a sample of the texts finds common last, so those rarely bring texts together; what they are
changes the work and not the links. Of texts that share a shingle neighbours are compared first, and then only what isn't connected yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import cut, partitions
from .components import components
from .simhash import fingerprint, linked_fingerprints
from .tokens import ragged

SHINGLE = 5
#: Shingles that COMMON or more of the sampled texts (one of SAMPLE) hold go last, at most MOST of them.
SAMPLE, COMMON, MOST = 16, 8, 100_000
#: Texts whose words lie in memory at a time.
TEXTS = 200
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes, sorted, one text after the other, and how many each has. Fewer words than a
    shingle are one shingle; no words are none."""
    import xxhash

    runs = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    begins = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    coded = runs.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    place = coded.indices.to_numpy()
    kept = real[place] if len(place) else np.zeros(0, bool)
    begins = np.concatenate([[0], np.cumsum(kept)])[begins]
    word = hashes[place[kept]] if len(place) else hashes
    sizes = np.diff(begins)
    n = np.where(sizes > 0, np.maximum(1, sizes - SHINGLE + 1), 0)
    at, owner = ragged(begins[:-1], n), np.repeat(np.arange(len(n)), n)
    ends, total = begins[1:][owner], np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < ends
        total[there] += word[at[there] + k] * _FACTORS[k]
    total ^= total >> np.uint64(32)
    total *= _FACTORS[0]
    total ^= total >> np.uint64(29)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.bincount(owner[new], minlength=len(n))


def _prefixes(shingles: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, of which similar sets share one, and whose they are. ``common`` is sorted by hash."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(common):
        near = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)]
        order = np.lexsort((shingles, near == shingles, owner))
        shingles = shingles[order]
    first = sizes - -(-4 * sizes // 5) + (sizes > 0)
    at = ragged(np.cumsum(sizes) - sizes, first)
    return shingles[at], np.repeat(np.arange(len(sizes)), first)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _sliced(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _longs(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names.split())


def _groups(batches, least: int):
    """Arrays (keys, sizes, labels) of the rows (shingle, n, key, label) of each shingle that come sorted by these, repeats dropped."""
    carried = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        shingle, n, key, label = (np.concatenate([c, batch.column(k).to_numpy()]) for k, c in enumerate(carried))
        if not len(shingle):
            continue
        last = int(np.flatnonzero(np.append(True, np.diff(shingle) != 0))[-1])
        yield from _cut_groups(shingle[:last], n[:last], key[:last], label[:last], least)
        carried = [x[last:] for x in (shingle, n, key, label)]
    yield from _cut_groups(*carried, least)


def _cut_groups(shingle, n, key, label, least):
    if not len(shingle):
        return
    new = np.append(True, (np.diff(shingle) != 0) | (np.diff(key) != 0))
    shingle, n, key, label = (x[new] for x in (shingle, n, key, label))
    begins = np.flatnonzero(np.append(True, np.diff(shingle) != 0))
    sizes = np.diff(np.append(begins, len(shingle)))
    for b, m in zip(begins[sizes >= least].tolist(), sizes[sizes >= least].tolist()):
        yield shingle[b : b + m], n[b : b + m], key[b : b + m], label[b : b + m]


ROW = "shingle long, n long, key long, label long"


def _shared(batches):
    """Rows of ROW of shingles that more than one key holds."""
    held, rows = [], 0
    for group in _groups(batches, 2):
        held.append(group)
        rows += len(group[0])
        if rows > 100_000:
            yield _longs("shingle n key label", *map(np.concatenate, zip(*held)))
            held, rows = [], 0
    if held:
        yield _longs("shingle n key label", *map(np.concatenate, zip(*held)))


def _pairs(batches, neighbours: bool):
    """Rows of PAIR for each shingle that two keys share and whose sizes and labels allow a link: each and the next greater one, or all."""
    for _, n, key, label in _groups(batches, 2):
        if neighbours:
            near = (5 * n[:-1] >= 4 * n[1:]) & (label[:-1] != label[1:])
            if near.any():
                yield _longs("a b m n", key[:-1][near], key[1:][near], n[:-1][near], n[1:][near])
            continue
        if (label == label[0]).all():
            continue
        for k in range(len(n) - 1):
            end = int(np.searchsorted(n, 5 * n[k] // 4, "right"))  # n is sorted
            other = label[k + 1 : end] != label[k]
            if other.any():
                many = np.ones(np.count_nonzero(other), np.int64)
                yield _longs("a b m n", key[k] * many, key[k + 1 : end][other], n[k] * many, n[k + 1 : end][other])


PAIR = "a long, b long, m long, n long"


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many shingles of their prefixes as similar sets must.

    Sets of m and n need m + n - (m + n) * 5 // 9 shingles in common, so at most (m + n) * 5 // 9 - n of the m are missed; the prefix that
    ends first holds the rest of itself within the other prefix.
    """
    need = lambda x, other: F.expr(f"{x} - cast(ceil(4 * {x} / 5) as long) + 1 - ((m + n) * 5 div 9 - {other})")
    return pairs.groupBy("a", "b", "m", "n").count().where(F.col("count") >= F.least(need("m", "n"), need("n", "m"))).select("a", "b")


#: Keys of candidates that are sent to every task; more are joined.
SENT = 1_000_000


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (key, text) are similar, as edges (u, v)."""
    asked = cut(_enough(pairs))
    ends = cut(asked.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    ends = F.broadcast(ends) if ends.count() <= SENT else ends

    def sets(batches):
        for batch in _sliced(batches):
            shingles, sizes = shingle_sets(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))], ["key", "set"])

    def check(batches):
        for batch in _sliced(batches):
            a, b = batch.column("x"), batch.column("y")
            hit = [similar(a[k].values.to_numpy(), b[k].values.to_numpy()) for k in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    found = cut(texts.join(ends, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(sets, "key long, set array<long>"))
    side = lambda c, s: found.select(F.col("key").alias(c), F.col("set").alias(s))
    return cut(asked.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(check, "u long, v long"))


def jaccard_edges(texts: DataFrame) -> DataFrame:
    """Edges (u, v) of keys that connect all texts (key, text) of similarity 0.8 or more, and no others directly."""
    spark = texts.sparkSession

    def spread(batches):
        for batch in _sliced(batches):
            yield _longs("shingle", shingle_sets(batch.column("text"))[0])

    seen = texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).dropDuplicates(["key"]).select("text").mapInArrow(spread, "shingle long")
    common = [r[0] for r in seen.groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST).collect()]
    shipped = spark.sparkContext.broadcast(np.sort(np.array(common, np.int64).view(np.uint64)))

    def prefixes(batches):
        for batch in _sliced(batches):
            shingles, sizes = shingle_sets(batch.column("text"))
            first, owner = _prefixes(shingles, sizes, shipped.value)
            key = batch.column("key").to_numpy()[owner]
            yield _longs("shingle n key label", first, sizes[owner].astype(np.int64), key, key)

    def sorted_by_shingle(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", "n", "key")

    shared = cut(sorted_by_shingle(texts.mapInArrow(prefixes, ROW)).mapInArrow(_shared, ROW))
    edges = _verified(sorted_by_shingle(shared).mapInArrow(lambda b: _pairs(b, True), PAIR), texts)
    reached = components(edges).select(F.col("node").alias("key"), "component")
    labelled = shared.join(reached, "key", "left").select("shingle", "n", "key", F.coalesce("component", "label").alias("label"))
    return edges.union(_verified(sorted_by_shingle(labelled).mapInArrow(lambda b: _pairs(b, False), PAIR), texts))


def simhash_edges(texts: DataFrame) -> DataFrame:
    """Edges (u, v) of keys that connect all texts (key, text) whose fingerprints link in op9."""

    def make(batches):
        for batch in batches:
            yield _longs("key fp", batch.column("key").to_numpy(), np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64))

    made = cut(texts.mapInArrow(make, "key long, fp long").distinct())
    classes = cut(made.groupBy("fp").agg(F.min("key").alias("rep")))
    side = lambda c, r: classes.select(F.col("fp").alias(c), F.col("rep").alias(r))
    equal = made.join(classes, "fp").where("key <> rep").select(F.col("rep").alias("u"), F.col("key").alias("v"))
    return equal.union(linked_fingerprints(classes).join(side("a", "u"), "a").join(side("b", "v"), "b").select("u", "v"))


def near_copy_components(texts: DataFrame) -> DataFrame:
    """(node, component) of the keys of texts (key: long, text: string, no nulls) that have a near copy; a key stands for one text."""
    return components(jaccard_edges(texts).union(simhash_edges(texts)))
