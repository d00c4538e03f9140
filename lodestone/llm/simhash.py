"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint becomes the vector of the bit counts of its 32 two-bit segments. The Manhattan distance of two vectors is at most the
Hamming distance of the fingerprints. The grid: 8 blocks of 4 segments; where vectors differ by 4 or less in all, at least 4 blocks
agree, so each fingerprint goes to the cells of all 70 choices of 4 blocks. Within a cell the Manhattan bound is checked first and
then the fingerprints; only links that join something new are kept, so a cell of n gives at most n - 1.

A cell of more than CELL fingerprints is first split by the bits themselves of the blocks that agree. That loses no link: of fingerprints
that differ by 4 bits at most, 4 blocks agree bit by bit, so in the cell of these the two also share a part. So the pairs that are
compared grow with the square of 2**-32 of the fingerprints, not of the fullest cell.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import cut, partitions, read_table, whole_texts
from .components import components

SHINGLE, SEED, BITS_APART = 4, 42, 4
BLOCKS, BLOCK_BITS = 8, 8
#: Fingerprints of a cell that are compared each with each.
CELL = 64
ODD = np.uint64(0x5555555555555555)
#: Bits of the blocks of each choice.
MASKS = np.array([sum(0xFF << (BLOCK_BITS * k) for k in c) for c in combinations(range(BLOCKS), BLOCKS - BITS_APART)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits that over half of the shingles' XXH64 set; no words: 0."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.cumsum(sizes) - sizes
    k = min(shingle, len(words))
    ends = (begins + sizes - 1)[k - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends.tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) for each row."""

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return whole_texts(docs).mapInArrow(make, "doc_id long, fp long")


def embedding(fps: np.ndarray) -> np.ndarray:
    """Each two-bit segment replaced by its bit count, the segments staying where they are."""
    return (fps & ODD) + ((fps >> np.uint64(1)) & ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: counts 0, 1, 2 in unary (1 as 01, 2 as 11) differ in as many bits."""
    unary = lambda e: (e | (e >> np.uint64(1))) & ODD | (e & ~ODD)
    return np.bitwise_count(unary(a) ^ unary(b))


def cells(fps: np.ndarray) -> np.ndarray:
    """Cell numbers, a row for each choice of blocks that agree and a column for each fingerprint."""
    e = embedding(fps)
    blocks = [(e >> np.uint64(BLOCK_BITS * k)) & np.uint64(0xFF) for k in range(BLOCKS)]
    return np.array([(np.uint64(n) << np.uint64(40)) | sum(blocks[k] << np.uint64(8 * i) for i, k in enumerate(choice)) for n, choice in enumerate(combinations(range(BLOCKS), BLOCKS - BITS_APART))], np.uint64)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ by BITS_APART at most: the lower bound first, then the bits."""
    out = manhattan(embedding(a), embedding(b)) <= BITS_APART
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= BITS_APART
    return out


def links_of_cell(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among the distinct fps, at most one less than they are."""
    rest, out = fps, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = close(np.broadcast_to(x, rest.shape), rest)
            if hit.any():
                out += [(int(x), int(y)) for y in rest[hit]]
                queue += list(rest[hit])
                rest = rest[~hit]
    return out


def parts_of_cell(cell: int, fps: np.ndarray) -> list[np.ndarray]:
    """The distinct fps of a cell as they are compared: together, or where they are many by the bits of the blocks that agree."""
    if len(fps) <= CELL:
        return [fps]
    bits = fps & MASKS[cell >> 40]
    order = np.argsort(bits)
    begins = np.flatnonzero(np.append(True, np.diff(bits[order]) != 0))
    return [x for x in np.split(fps[order], begins[1:]) if len(x) > 1]


def _linked(batches):
    """Links within the cells of rows (cell, fp) that come sorted by cell; a cell may go on in the next batch."""
    carried = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(cell: np.ndarray, fp: np.ndarray):
        fps = fp.view(np.uint64)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
        sizes = np.diff(np.append(begins, len(cell)))
        pair = begins[sizes == 2]
        hit = close(fps[pair], fps[pair + 1]) if len(pair) else np.zeros(0, bool)
        found = list(zip(fps[pair[hit]].tolist(), fps[pair[hit] + 1].tolist()))
        for b, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for part in parts_of_cell(int(cell[b]), fps[b : b + n]):
                found += links_of_cell(part)
        a = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    for batch in batches:
        cell, fp = (np.concatenate([c, batch.column(n).to_numpy()]) for c, n in zip(carried, ("cell", "fp")))
        if not len(cell):
            continue
        last = int(np.searchsorted(cell, cell[-1]))
        carried = (cell[last:], fp[last:])
        if last:
            yield links(cell[:last], fp[:last])
    if len(carried[0]):
        yield links(*carried)


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column fp) within reach of each other."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").to_numpy()[at : at + 4096]
                grid = cells(fps.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grid.ravel()), pa.array(np.tile(fps, len(grid)))], ["cell", "fp"])

    n = partitions(distinct.sparkSession)
    dealt = distinct.select("fp").mapInArrow(spread, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_linked, "a long, b long").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs; rows link where fingerprints differ by BITS_APART bits at most.

    Equal fingerprints are one class before links are looked for. Nulls: a null text is empty, so its fingerprint is zero; a null
    doc_id is never the smallest, and a class of null ids alone links nothing and has a null component. Repeated rows and ties share a
    class, very long texts are hashed whole, an empty table gives an empty table, other columns are left behind.
    """
    made = cut(fingerprints(docs))
    classes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    side = lambda c, r: classes.select(F.col("fp").alias(c), F.col("rep").alias(r))
    edges = linked_fingerprints(classes).join(side("a", "u"), "a").join(side("b", "v"), "b").select("u", "v")
    reached = components(edges)
    labelled = classes.join(reached, classes["rep"] == reached["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(labelled, "fp", "left").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
