"""Exact nearest neighbours: groups of queries against groups of rows, the best of each pair of groups before the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.distance import scores

#: Queries and rows compared at a time, most numbers of one side that meet in a task, and rows below which a side isn't cut for more tasks.
QUERIES, ROWS, NUMBERS, FEW = 512, 8192, 1 << 22, 4096


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(metric: str, ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool = False, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, nearness) of the k nearest rows of each query, known by its place, ties by id. allowed: which rows may meet which queries.

    Candidates come of one product of matrices, with room for what that rounds away; then each pair's value is worked out alone, so
    it doesn't depend on what else was in the batch.
    """
    near = scores(metric, rows, queries)
    if exclude_self:
        near[ids[:, None] == qids[None, :]] = -np.inf
    if allowed is not None:
        near[~allowed] = -np.inf
    slack = 1e-9 * (1 + np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1] + (0 if metric == "dot" else (rows**2).sum(1).max(initial=0) + (queries**2).sum(1).max(initial=0)))
    if len(ids) <= k:
        least = np.full(len(qids), -np.inf)
    else:
        least = (near.max(0) if k == 1 else np.partition(near, len(ids) - k, axis=0)[len(ids) - k]) - slack
    row, column = np.nonzero((near >= least) & (near > -np.inf))
    a, b = rows[row], queries[column]
    value = np.round((a * b).sum(1) if metric == "dot" else -((a - b) ** 2).sum(1), 12)
    return best([(column, ids[row], value)], k)


def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts (query, id, nearness) together the k nearest of each query, in order."""
    column, ids, value = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.int64, np.float64), zip(*found) if found else [()] * 3))
    order = np.lexsort((ids, -value, column))
    order = order[np.arange(len(order)) - np.searchsorted(column[order], column[order]) < k]
    return column[order], ids[order], value[order]


def packed(batch: pa.RecordBatch, group: np.ndarray, ids: str, vectors: str, **more: np.ndarray) -> pa.RecordBatch:
    """Rows as one row a group: group, ids, vectors and more as bytes. Vectors stay 32 bits wide if they are."""
    column = batch.column(vectors)
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    x = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), kind)
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)[: len(order)])
    parts = [order[a:b] for a, b in zip(begin, np.append(begin[1:], len(order)))]
    columns = {"ids": batch.column(ids).to_numpy().astype(np.int64, copy=False), "vectors": x, **more}
    arrays = [pa.array(group[order[begin]].astype(np.int32)), *(pa.array([v[i].tobytes() for i in parts], pa.binary()) for v in columns.values()), pa.array(np.full(len(parts), kind is np.float32))]
    return pa.RecordBatch.from_arrays(arrays, ["part", *columns, "single"])


PACKED = "part int, ids binary, vectors binary"


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of packed rows, and their vectors as 64-bit numbers."""
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    parts = [np.frombuffer(v, np.float32 if single else np.float64).astype(np.float64) for v, single in zip(table.column("vectors").to_pylist(), table.column("single").to_pylist())]
    return ids, np.concatenate([np.zeros(0), *parts]).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def dealt(ids: np.ndarray, n: int) -> np.ndarray:
    """One of n groups for each id."""
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def grid(rows: int, queries: int, dim: int, partitions: int) -> tuple[int, int]:
    """Groups of rows and groups of queries, each of them small enough for a task; more of rows if there are too few tasks."""
    side = max(1, NUMBERS // max(1, dim))
    of_queries = max(1, -(-queries // side))
    return max(1, -(-rows // side), min(-(-rows // FEW), -(-partitions // of_queries))), of_queries


def knn(records: DataFrame, queries: DataFrame, k: int, metric: str = "dot", exclude_self: bool = False) -> DataFrame:
    """(qid, rank, vec_id, score): the k nearest records (vec_id, embedding) of each query (qid, qv), ties by vec_id. For l2 score is the squared distance.

    Rows and queries are dealt into groups of bounded size, and each group of the ones meets each of the others in a task. Only counts
    reach the driver.
    """
    rows = records.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null")
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "qv").where("qid is not null and qv is not null")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_rows, n_queries = grid(n, asked.count(), dim or 1, partitions)

    def packer(ids: str, vectors: str, groups: int):
        def pack(batches):
            for batch in batches:
                yield packed(batch, dealt(batch.column(ids).to_numpy(), groups), ids, vectors)

        return pack

    def meet(key, left, right):
        (qids, q), (ids, x) = unpacked(left), unpacked(right)
        out = []
        for a in range(0, len(qids) if len(ids) else 0, QUERIES):
            some = slice(a, a + QUERIES)
            column, of, value = best([nearest(metric, ids[b : b + ROWS], x[b : b + ROWS], qids[some], q[some], k, exclude_self) for b in range(0, len(ids), ROWS)], k)
            out.append((qids[some][column], of, value))
        return pa.table(dict(zip(["qid", "vec_id", "near"], (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.int64, np.float64), zip(*out) if out else [()] * 3)))))

    schema = PACKED + ", single boolean"
    cell = F.explode(F.expr(f"transform(sequence(0, {n_rows - 1}), x -> part * {n_rows} + x)"))
    left = asked.mapInArrow(packer("qid", "qv", n_queries), schema).withColumn("cell", cell)
    cell = F.explode(F.expr(f"transform(sequence(0, {n_queries - 1}), x -> x * {n_rows} + part)"))
    right = rows.mapInArrow(packer("vec_id", "embedding", n_rows), schema).withColumn("cell", cell)
    # by number, as Spark would put small partitions together by their bytes, which say little of the work
    left, right = (x.repartition(partitions, "cell") for x in (left, right))
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, "qid long, vec_id long, near double")
    return ranked(found, k, metric)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The k nearest of each query among found (qid, vec_id, near)."""
    order = Window.partitionBy("qid").orderBy(F.col("near").desc(), "vec_id")
    first = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return first.select("qid", "rank", "vec_id", (F.col("near") if metric == "dot" else -F.col("near")).alias("score"))
