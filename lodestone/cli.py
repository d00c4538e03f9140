"""python -m lodestone.cli experiment NAME DATA_FOLDER [flags] | compare RESULTS.csv ... | test [DATA_FOLDER] | defaults dataset|index"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .config import IndexConfig, from_yaml, to_yaml
from .index import DEFAULT_CANDIDATES, STRATEGIES, VectorIndex
from .logs import LOGGER, log_init, log_time
from .operators.evaluate import evaluate
from .operators.exact import knn
from .sources.datasets import catalogue, default_catalogue, read_results, write_results
from .sources.storage import numbered


def _log(message: str, **fields) -> None:
    LOGGER.info(message, extra={"fields": fields})


@log_time
def loaded(index: VectorIndex, vectors: DataFrame, limit: int | None, validate_after: int, each: int, budgets: list[int]) -> VectorIndex:
    """Inserts the first ``limit`` vectors by id. With validate_after, so many at a time, and after each such load every row whose id
    is divisible by ``each`` is searched for among all that are in; otherwise all at once."""
    rows, n = numbered(vectors, ["vec_id"])
    n = n if limit is None else min(n, limit)
    for start in range(0, n, validate_after or max(1, n)):
        stop = min(n, start + (validate_after or n))
        index.insert(rows.where(F.col("seq").between(start, stop - 1)).select("vec_id", "embedding"))
        if validate_after:
            there = rows.where(F.col("seq") < stop)
            queries = there.where(F.col("vec_id") % each == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
            if queries.limit(1).count():
                for row in evaluate(index, queries, knn(there, queries, 10, index.config.distance_fn), budgets).collect():
                    _log("validation", inserted=stop, **row.asDict())
    return index


def run_folder(parent: str, name: str, force: bool) -> Path:
    """A new folder for what a run leaves. One that exists raises, or with force is emptied."""
    folder = Path(parent) / name
    if folder.exists():
        if not force:
            raise FileExistsError(f"{folder} exists; --force replaces it")
        shutil.rmtree(folder)
    folder.mkdir(parents=True)
    return folder


def experiment(a: argparse.Namespace) -> None:
    folder = run_folder(a.experiments_dir, a.name, a.force)
    log_init(str(folder / "logs.jsonl") if a.log_output == "file" else sys.stdout, "DEBUG" if a.verbose > 1 else "INFO")
    spark = SparkSession.builder.getOrCreate()
    if a.skip_progress_bar:
        spark.sparkContext.setLogLevel("ERROR")
    config = from_yaml(a.index_config) if a.index_config else IndexConfig()
    (folder / "index.yaml").write_text(to_yaml(config))
    parts = catalogue(spark, a.folder)
    _log("dataset", folder=a.folder, config=repr(config))
    vectors = parts["dataset"].withColumn("vec_id", F.col("vec_id") + 1) if a.start_from_one else parts["dataset"]
    index = loaded(VectorIndex(spark, config), vectors, a.limit, 0 if a.skip_validation else a.validate_after_n, a.include_each_n_val, a.ncandidates)
    _log("filled", **index.stats().first().asDict())
    if a.output_dir:
        index.save(a.output_dir)
    if not a.skip_search:
        found = evaluate(index, parts["queries"], parts["ground_truth"], a.ncandidates, search_strategy=a.search_strategy).cache()
        write_results(found, str(folder))
        for row in found.collect():
            _log("metrics", **row.asDict())
        found.show(len(a.ncandidates) + 1)


def compare(a: argparse.Namespace) -> None:
    """The results of several runs, side by side."""
    found = read_results(SparkSession.builder.getOrCreate(), a.results)
    found.orderBy("ncandidates").show(1000, False)


def smoke(a: argparse.Namespace) -> None:
    """The first 100 queries of a data set as vectors of a small index, validated on each of them."""
    log_init(sys.stdout, "DEBUG")
    spark = SparkSession.builder.getOrCreate()
    queries = catalogue(spark, a.folder)["queries"]
    vectors = queries.select(F.col("qid").alias("vec_id"), F.col("qv").alias("embedding")) if "qid" in queries.columns else queries
    first = vectors.first()
    if first is None:
        raise ValueError("the data set has no queries")
    index = VectorIndex(spark, IndexConfig(input_shape=len(first["embedding"]), bucket_size=20, buffer_size=20))
    loaded(index, vectors, 100, 100, 1, [100])
    _log("filled", **index.stats().first().asDict())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("defaults", help="print a default configuration as YAML")
    d.add_argument("of", choices=["dataset", "index"])
    t = sub.add_parser("test", help="load and validate 100 vectors")
    t.add_argument("folder", nargs="?", default="data/example")
    c = sub.add_parser("compare", help="show the results of several experiments")
    c.add_argument("results", nargs="+", help="CSV files that experiments left")
    e = sub.add_parser("experiment", help="load, validate, save and search")
    e.add_argument("name")
    e.add_argument("folder", help="holds dataset, queries and ground truth; config.yaml may say where")
    e.add_argument("-i", "--index-config", help="YAML")
    e.add_argument("-f", "--force", action="store_true", help="replace an experiment of the same name")
    e.add_argument("--log-output", choices=["file", "stdout"], default="file")
    e.add_argument("--validate-after-n", type=int, default=50_000)
    e.add_argument("--include-each-n-val", type=int, default=1000)
    e.add_argument("--search-strategy", choices=STRATEGIES, default="model")
    e.add_argument("-n", "--ncandidates", type=int, nargs="*", default=[10_000], help=f"rows to visit a query (the library's default: {DEFAULT_CANDIDATES})")
    e.add_argument("-l", "--limit", type=int)
    e.add_argument("-e", "--experiments-dir", default="experiments_data")
    e.add_argument("-o", "--output-dir", help="where the index is saved")
    e.add_argument("-v", "--verbose", action="count", default=0)
    for flag in ("--skip-validation", "--skip-search", "--skip-progress-bar", "--start-from-one"):
        e.add_argument(flag, action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "defaults":
        print(default_catalogue() if a.of == "dataset" else to_yaml(IndexConfig()), end="")
    else:
        {"experiment": experiment, "compare": compare, "test": smoke}[a.command](a)


if __name__ == "__main__":
    main()
