"""Best-fit packing by large-item matching, planned over counts of lengths.

An item is a piece of at most ``capacity`` tokens. Of items longer than a third of it at most two share a bin: they are matched
greedily, the longest first with the longest that fits. Shorter items then go, longest first, to the smallest gap that takes them.
Only lengths matter, so the plan is made over the (at most ``capacity``) counts of lengths, as runs: so many items of a length into
so many consecutive bins at an offset. Items find their run by their rank among items of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from .common import cut, give_back, read_table, whole_texts
from .tokens import slices, vocabulary, word_encoder

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, offset) that place counts[length] items of each length.

    A run ends a length or uses up an interval of bins with one gap; each length splits at most one interval, so the intervals, and
    with them the runs, are bounded by the capacity and not by the items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    runs, gaps, bins = [], defaultdict(list), 0  # gaps: gap -> intervals (first bin, bins)

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, offset))
        taken[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if left[n] and n <= min(a, capacity - a) and (n != a or left[a] > 1)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            place(a, n, bins, 0)
            if b is not None:
                place(b, n, bins, a)
            if gap := capacity - a - (b or 0):
                gaps[gap].append((bins, n))
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s and gaps[g]), default=None)
            if gap is None:  # no room: new bins, each filled with this length as far as the items go
                each = capacity // s
                new = -(-left[s] // each)
                gaps[capacity].append((bins, new))
                bins += new
                gap = capacity
            first, n = gaps[gap].pop()
            if n > left[s]:
                gaps[gap].append((first + left[s], n - left[s]))
                n = left[s]
            place(s, n, first, capacity - gap)
            if gap > s:
                gaps[gap - s].append((first, n))
    return runs


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each row of docs: its ids and then END_ID, cut every ``capacity`` ids, and a rank among the task's pieces of that length."""

    def encode(batches):
        encoder, task, seen = word_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, begins = encoder.encode(part.column("text"))
                sizes = np.diff(begins) + 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, sizes[doc] - piece * capacity)
                order = np.argsort(length, kind="stable")
                runs = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1]) if len(doc) else np.zeros(0, np.int64)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(runs, np.diff(np.append(runs, len(doc)))) + seen[length[order]]
                np.add.at(seen, length, 1)
                all_ids = np.insert(ids.astype("<u4"), begins[1:], END_ID) if len(sizes) else ids.astype("<u4")
                first = (begins[:-1] + np.arange(len(sizes)))[doc] + piece * capacity
                cuts = [all_ids[a : a + n] for a, n in zip(first.tolist(), length.tolist())]
                cols = {
                    "doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * capacity, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cuts], pa.int64()), "task": pa.array(np.full(len(doc), task), pa.int32()), "rank": pa.array(rank, pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
            give_back()

    return whole_texts(docs).mapInArrow(encode, PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset for each piece of each row of docs.

    Nulls: a null text is empty and becomes one piece of END_ID alone; a null doc_id stays null. Repeated rows are packed each on
    its own, ties of equal lengths are told apart by task and rank, very long texts are encoded whole and cut, an empty table gives an empty table, other columns are left behind.
    Only counts by length (at most ``capacity`` rows) reach the driver, and only the plan's runs, bounded alike, are broadcast.
    """
    spark = docs.sparkSession
    pieces = cut(tokenized_pieces(docs, path, capacity, with_ids))
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = pd.DataFrame(plan_bins(counts, capacity), columns=["length", "rank_from", "items", "bin", "offset"]).astype("int64")
    plan = spark.createDataFrame(runs, "length long, rank_from long, items long, bin long, offset long")
    ranked = pieces.join(based, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    at = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["rank_from"]) & (ranked["rank"] < plan["rank_from"] + plan["items"])
    placed = ranked.join(F.broadcast(plan), at).withColumn("sequence_id", plan["bin"] + ranked["rank"] - plan["rank_from"])
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))
