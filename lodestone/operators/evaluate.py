"""Recall and throughput."""

from __future__ import annotations

import time

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..index import VectorIndex


def recall(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: the mean over all queries of the share of the true k nearest that are among the k found."""
    hits = results.where(F.col("rank") <= k).select("qid", "vec_id").join(truth.where(F.col("rank") <= k).select("qid", "vec_id"), ["qid", "vec_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return queries.select("qid").join(hits, "qid", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def evaluate(index: VectorIndex, queries: DataFrame, truth: DataFrame, budgets: list[int], k: int = 10, search_strategy: str = "model") -> DataFrame:
    """(ncandidates, total, recall1, recall5, recall10, elapsed_s, qps, avg_ms) for each budget."""
    total, rows = queries.count(), []
    for n in budgets:
        began = time.time()
        found = index.search(queries, k, n, search_strategy).cache()
        found.count()
        took = time.time() - began
        r = [recall(found, truth, queries, x).first()["recall"] for x in (1, 5, 10)]
        found.unpersist()
        rows.append((n, total, *r, took, total / took, took / max(1, total) * 1000))
    return index.spark.createDataFrame(rows, "ncandidates long, total long, recall1 double, recall5 double, recall10 double, elapsed_s double, qps double, avg_ms double")
