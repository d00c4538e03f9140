"""Data sets of an experiment: vectors, queries and ground truth, by convention or by a YAML catalogue."""

from __future__ import annotations

import os

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"dataset": "data.parquet", "queries": "queries.parquet", "ground_truth": "gt.parquet"}


def read_hdf5(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A 2-D data set as (vec_id, embedding), or lists of neighbours (``knns``) as (qid, knns); needs h5py on the driver."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; convert the file to Parquet") from e
    with h5py.File(path) as f:
        if name == "knns":
            return spark.createDataFrame(((i, [int(x) for x in row]) for i, row in enumerate(f[name])), "qid long, knns array<long>")
        return spark.createDataFrame(((i, [float(x) for x in row]) for i, row in enumerate(f[name])), "vec_id long, embedding array<float>")


def default_catalogue() -> str:
    """The usual names, as a catalogue in YAML."""
    import yaml

    return yaml.safe_dump({k: {"type": "parquet", "value": {"path": v}} for k, v in DEFAULTS.items()}, sort_keys=False)


def catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """config.yaml names each part's type, path and name; without it the parts have their usual names."""
    parts = {k: {"type": "parquet", "value": {"path": v}} for k, v in DEFAULTS.items()}
    if os.path.exists(config := f"{folder}/config.yaml"):
        import yaml

        with open(config) as f:
            parts |= yaml.safe_load(f)
    out = {}
    for name, part in parts.items():
        path = part["value"]["path"]
        path = path if os.path.isabs(path) or "://" in path else f"{folder}/{path}"
        out[name] = read_hdf5(spark, path, part["value"].get("dataset_name", "emb")) if part["type"] == "h5" else spark.read.format(part["type"]).load(path)
    if "knns" in out["ground_truth"].columns:
        out["ground_truth"] = ranked_truth(out["ground_truth"])
    return out


def ranked_truth(lists: DataFrame) -> DataFrame:
    """(qid, rank, vec_id) of rows (qid, knns)."""
    return lists.select("qid", F.posexplode("knns").alias("rank", "vec_id")).select("qid", (F.col("rank") + 1).cast("long").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON-lines log that carry metrics, times or data sets."""
    return spark.read.json(path).where(F.col("message").isin("metrics", "time", "dataset"))


def write_results(results: DataFrame, folder: str, name: str = "results") -> str:
    """The (few) rows of results as folder/name.csv, or with a number where that is taken; returns the path."""
    path, k = f"{folder}/{name}.csv", 2
    while os.path.exists(path):
        path, k = f"{folder}/{name}.{k}.csv", k + 1
    results.toPandas().to_csv(path, index=False)
    return path


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Results of several runs as one table; columns that a run lacks are null."""
    out = None
    for path in paths:
        one = spark.read.csv(path, header=True, inferSchema=True)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
