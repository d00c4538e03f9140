import glob
import os
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodestone.config import ConfigError, IndexConfig, TrainParams, from_dict
from lodestone.functions.distance import records_per_block
from lodestone.index import VectorIndex
from lodestone.operators import leveling
from lodestone.operators.exact import knn
from lodestone.operators.router import MlpRouter
from lodestone.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    a, b = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    assert order(a).equals(order(b))


@pytest.mark.parametrize("n, arity, bucket, buffer, levels, left, moved", [
    (10, 2, 5000, 10, [10], 0, 10), (15, 2, 5000, 10, [10], 5, 10), (30, 2, 10, 10, [0, 30], 0, 50), (59, 2, 10, 10, [20, 30], 9, 70),
    (100, 2, 10, 10, [10, 30, 60], 0, 190), (500, 2, 10, 10, [20, 0, 0, 0, 0, 480], 0, 1780), (59, 3, 20, 50, [50], 9, 50),
    (300000, 3, 200, 200, [0, 0, 4800, 14400, 21600, 64800, 194400], 0, 1411400),
])
def test_placement_by_counts(n, arity, bucket, buffer, levels, left, moved):
    state = leveling.State(IndexConfig(arity=arity, bucket_size=bucket, buffer_size=buffer))
    assert state.insert(n) == moved
    assert [state.occupied(i) for i in range(len(state.levels))] == levels and state.buffered() == left


def points(spark, n, dim=3):
    return spark.createDataFrame([(i, [float(i)] * dim) for i in range(n)], "vec_id long, embedding array<float>")


TINY = IndexConfig(arity=2, bucket_size=10, buffer_size=10, input_shape=3, distance_fn="l2", rebuild_strategy="basic_rebuild")


def test_insert_in_parts_search_delete_and_reload(spark, tmp_path):
    rows = points(spark, 59)
    index = VectorIndex(spark, TINY).insert(rows.where("vec_id < 33")).insert(rows.where("vec_id >= 33"))
    assert index.levels == [20, 30] and index.buffered == 9
    asked = rows.selectExpr("vec_id as qid", "embedding as qv")
    expected = sorted(knn(rows, asked, 5, "l2").collect())
    assert sorted(index.search(asked, 5, 1000).collect()) == expected
    assert index.search(asked, 5, 0).count() == 0
    index.save(str(tmp_path / "x"))
    again = VectorIndex.load(spark, str(tmp_path / "x"))
    assert sorted(again.search(asked, 5, 1000).collect()) == expected
    assert again.delete(rows.where("vec_id in (3, 58, 1000)").select("vec_id")) == 2
    assert {3, 58}.isdisjoint(r["vec_id"] for r in again.search(asked, 5, 1000).collect())
    with pytest.raises(Exception, match="exists"):
        index.save(str(tmp_path / "x"))


def test_empty_index_and_wrong_dimension(spark):
    index = VectorIndex(spark, TINY)
    assert index.search(points(spark, 2).selectExpr("vec_id as qid", "embedding as qv"), 3, 10).count() == 0
    with pytest.raises(Exception, match="must have 3 elements"):
        index.insert(points(spark, 2, dim=4))


def test_router_learns_blobs_and_quantized_too():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0.2, 1e-4, (50, 2)), rng.normal(0.8, 1e-4, (50, 2))])
    y = np.repeat([0, 1], 50)
    for quantize in (False, True):
        net = MlpRouter.fit(x, y, 2, IndexConfig(train=TrainParams(epochs=50, batch_size=16), quantize=quantize))
        p = net.probabilities(x)
        assert (p.argmax(1) == y).all() and np.allclose(p.sum(1), 1)


def test_configuration_is_checked():
    c = from_dict({"levels": {"bucket_size": 7, "model": {"layers": [{"type": "linear", "value": 4}, {"type": "relu"}]}}, "buffer_size": 7, "compaction_strategy": "bentley_saxe:greedy_rebuild"})
    assert c.bucket_size == 7 and c.rebuild_strategy == "greedy_rebuild" and c.layers == (("linear", 4), ("relu", 0))
    for bad in ({"arity": 1}, {"buffer_size": "7"}, {"nonsense": 1}, {"compaction_strategy": "other"}, {"buffer_size": 10**9}):
        with pytest.raises(ConfigError):
            from_dict(bad)
    assert records_per_block(768) == 42


def test_configurations_survive_yaml(tmp_path):
    from lodestone import config as c

    for one in (c.IndexConfig(), c.IndexConfig(input_shape=3, bucket_size=7, buffer_size=9, rebuild_strategy="greedy_rebuild", layers=(("linear", 5),), seed=4, train=c.TrainParams(epochs=9))):
        (tmp_path / "one.yaml").write_text(c.to_yaml(one))
        assert c.from_yaml(str(tmp_path / "one.yaml")) == one


def test_unknown_search_strategy(spark):
    with pytest.raises(ValueError):
        VectorIndex(spark, IndexConfig(input_shape=2)).search(spark.createDataFrame([(0, [1.0, 2.0])], "qid long, qv array<float>"), search_strategy="knn")


def test_command_line(spark, tmp_path, capsys):
    from lodestone import cli
    from lodestone.operators.exact import knn
    from lodestone.sources.datasets import read_logs

    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(240)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 12 = 0").selectExpr("vec_id AS qid", "embedding AS qv")
    vectors.write.parquet(f"{tmp_path}/data.parquet")
    queries.write.parquet(f"{tmp_path}/queries.parquet")
    knn(vectors, queries, 10, "dot").write.parquet(f"{tmp_path}/gt.parquet")
    cli.main(["defaults", "index"])
    config = tmp_path / "index.yaml"
    config.write_text(capsys.readouterr().out.replace("input_shape: 768", "input_shape: 4").replace("buffer_size: 5000", "buffer_size: 20").replace("bucket_size: 5000", "bucket_size: 20"))
    command = ["experiment", "one", str(tmp_path), "-i", str(config), "-e", f"{tmp_path}/runs", "--validate-after-n", "150", "--include-each-n-val", "50", "-n", "40", "100000", "-o", f"{tmp_path}/saved"]
    cli.main(command)
    metrics = {r["ncandidates"]: r for r in read_logs(spark, f"{tmp_path}/runs/one/logs.jsonl").collect() if r["message"] == "metrics"}
    assert metrics[100000]["recall10"] == 1.0 and metrics[40]["recall10"] <= 1.0
    checks = spark.read.json(f"{tmp_path}/runs/one/logs.jsonl").where("message = 'validation' and ncandidates = 100000").collect()
    assert [(r["inserted"], r["total"], r["recall1"]) for r in checks] == [(150, 3, 1.0), (240, 5, 1.0)]
    assert VectorIndex.load(spark, f"{tmp_path}/saved").stats().first()["occupied"] == 240
    with pytest.raises(FileExistsError):
        cli.main(command)
    cli.main([*command[:-2], "--force", "--skip-validation", "--limit", "50", "--skip-search"])
    assert not {"validation", "metrics"} & {r["message"] for r in spark.read.json(f"{tmp_path}/runs/one/logs.jsonl").collect()}
    cli.main(["test", str(tmp_path)])
    cli.main(["defaults", "dataset"])
    assert "ground_truth" in capsys.readouterr().out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def offset_ramps():
    return np.arange(59)[:, None] / 10 + np.arange(640) / 1000


def unit_patterns():
    a, b = np.arange(59)[:, None] / 59, np.arange(640) / 640
    rows = np.where(a * 59 < 20, np.sin(a * 2 * np.pi + b * np.pi) / 2 + a, np.where(a * 59 < 40, np.cos(a * 2 * np.pi - b * np.pi) / 2 + 1 - a, a * b + (1 - a) * (1 - b)))
    return rows / np.linalg.norm(rows, axis=1)[:, None]


@pytest.mark.parametrize("rows, metric, cold", [(offset_ramps, "l2", False), (unit_patterns, "dot", False), (unit_patterns, "dot", True)])
def test_recall_at_a_budget_of_ten_rows(spark, tmp_path, rows, metric, cold):
    """Trained routers, 59 vectors of which each looks for itself."""
    config = IndexConfig(buffer_size=50, bucket_size=20, input_shape=640, arity=3, distance_fn=metric)
    if cold:
        config = config.with_(cold_storage_dir=str(tmp_path), cold_threshold_level=0, cold_cache_size_bytes=1 << 20)
    vectors = vectors_of(spark, rows())
    index = VectorIndex(spark, config).insert(vectors)
    assert index.levels == [50] and index.buffered == 9 and all(p.cold == cold for p in index.parts[0])
    for _ in range(2):  # the second time cold buckets come from the cache
        found = index.search(vectors.selectExpr("vec_id AS qid", "embedding AS qv"), 1, 10).collect()
        assert sum(r["qid"] == r["vec_id"] for r in found) > 0.9 * 59
    assert bool(index._cold_cache) == cold


def test_recall_of_trained_routers_on_clusters(spark):
    from lodestone.operators.evaluate import evaluate

    rng = np.random.default_rng(1)
    vectors = vectors_of(spark, rng.permutation(np.repeat(rng.normal(size=(9, 16)), 80, 0) + 0.05 * rng.normal(size=(720, 16))))
    config = IndexConfig(buffer_size=30, bucket_size=30, input_shape=16, arity=3, distance_fn="l2", train=TrainParams(epochs=60, batch_size=32))
    asked = vectors.where("vec_id % 10 = 0").selectExpr("vec_id AS qid", "embedding AS qv")
    found = {r["ncandidates"]: r for r in evaluate(VectorIndex(spark, config).insert(vectors), asked, knn(vectors, asked, 10, "l2"), [240, 10_000]).collect()}
    assert found[240]["recall10"] >= 0.9 and found[10_000]["recall10"] == 1.0 and found[240]["total"] == 72


def test_verbs_write_only_what_they_touch(spark):
    index = VectorIndex(spark, TINY).insert(points(spark, 55))
    before = {i: list(p) for i, p in index.parts.items()}
    assert index.levels == [20, 30] and index.buffered == 5
    for k in range(3):
        index.insert(points(spark, 100 + k).where(f"vec_id = {99 + k}"))
        assert [index.parts[i] for i in (0, 1)] == [before[0], before[1]] and len(index.parts[-1]) == len(before[-1]) + k + 1
    assert index.delete(points(spark, 3).select("vec_id")) == 3  # of one level
    assert sum(index.parts[i] == before[i] for i in (0, 1)) == 1 and len(index._replaced) == 1
    gone = index._replaced[0].path
    assert os.path.exists(gone.removeprefix("file:"))
    index.delete(points(spark, 102).where("vec_id = 99").select("vec_id"))
    assert not os.path.exists(gone.removeprefix("file:"))
    assert index.delete(points(spark, 2000).where("vec_id > 1000").select("vec_id")) == 0
    assert sorted(r["vec_id"] for r in index.records.collect()) == [*range(3, 55), 100, 101] and sum(index.levels) + index.buffered == 54


def test_cold_levels_stay_cold(spark, tmp_path):
    config = TINY.with_(cold_storage_dir=str(tmp_path / "cold"), cold_threshold_level=1, rebuild_strategy="no_rebuild")
    rows = points(spark, 59)
    index = VectorIndex(spark, config).insert(rows)
    cold = lambda x: {i: {p.cold for p in parts} for i, parts in x.parts.items() if parts}
    assert cold(index) == {0: {False}, 1: {True}, -1: {False}}
    index.delete(rows.where("vec_id % 5 = 0").select("vec_id"))
    index.insert(points(spark, 103).where("vec_id >= 101"))
    assert cold(index) == {0: {False}, 1: {True}, -1: {False}}
    index.save(str(tmp_path / "saved"))
    again = VectorIndex.load(spark, str(tmp_path / "saved"))
    assert cold(again) == cold(index) and again.parts[1] == index.parts[1] and not (tmp_path / "saved/records/level=1").exists()
    asked = rows.selectExpr("vec_id AS qid", "embedding AS qv")
    left = rows.where("vec_id % 5 <> 0").union(points(spark, 103).where("vec_id >= 101"))
    assert sorted(again.search(asked, 4, 1000).collect()) == sorted(index.search(asked, 4, 1000).collect()) == sorted(knn(left, asked, 4, "l2").collect())
    assert index.memory_usage() < VectorIndex.load(spark, str(tmp_path / "saved")).copy(cold_threshold_level=None).memory_usage()


def test_null_rows_repeated_ids_and_one_query(spark):
    rows = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (None, [2.0, 2.0, 2.0]), (3, None), (4, [4.0, 4.0, 4.0])], "vec_id long, embedding array<float>")
    index = VectorIndex(spark, TINY).insert(rows)
    assert index.buffered == 2 and index.search_one([4, 4, 4], 1) == [4]
    index.upsert(spark.createDataFrame([(1, [7.0, 0.0, 0.0]), (1, [9.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["embedding"][0]) for r in index.records.collect()) == [(1, 9.0), (4, 4.0), (5, 0.0)]
    asked = spark.createDataFrame([(0, None), (None, [4.0, 4.0, 4.0]), (2, [4.0, 4.0, 4.0])], "qid long, qv array<float>")
    assert [(r["qid"], r["vec_id"]) for r in index.search(asked, 1).collect()] == [(2, 4)]


def test_hot_buckets_are_searched_in_pieces(spark, monkeypatch):
    from lodestone import index as module

    monkeypatch.setattr(module, "PIECE", 4)
    rows, asked = points(spark, 59), points(spark, 59).selectExpr("vec_id as qid", "embedding as qv")
    assert sorted(VectorIndex(spark, TINY).insert(rows).search(asked, 5, 1000).collect()) == sorted(knn(rows, asked, 5, "l2").collect())


def test_retraining_by_strategy(spark):
    for strategy, changes in (("no_retrain", False), ("from_scratch", True)):
        index = VectorIndex(spark, TINY.with_(train=TrainParams(retrain_strategy=strategy))).insert(points(spark, 25))
        before = index.routers[0]
        index.retrain(0)
        assert (index.routers[0] is not before) == changes and index.levels == [20]
        index.insert(points(spark, 50).where("vec_id >= 25"))  # level 0 is emptied and filled again
        assert sorted(r["vec_id"] for r in index.records.collect()) == list(range(50))


def test_long_vectors_keep_their_digits(spark):
    rows = vectors_of(spark, [[1e6 + k, 1e6, 1e6] for k in (0, 0.25, 0.5)])
    found = knn(rows, rows.selectExpr("vec_id AS qid", "embedding AS qv"), 3, "l2").orderBy("qid", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found[:3]] == [(0, 0.0), (1, 0.0625), (2, 0.25)]


def test_results_as_csv_and_truth_as_lists(spark, tmp_path, capsys):
    from lodestone import cli
    from lodestone.sources.datasets import catalogue, read_results, write_results

    one = spark.createDataFrame([(10, 0.5)], "ncandidates long, recall1 double")
    paths = [write_results(one, str(tmp_path)), write_results(one.selectExpr("ncandidates", "0.25 AS recall5"), str(tmp_path))]
    assert [os.path.basename(p) for p in paths] == ["results.csv", "results.2.csv"]
    assert sorted((r["recall1"] or 0, r["recall5"] or 0) for r in read_results(spark, [f"file:{p}" for p in paths]).collect()) == [(0, 0.25), (0.5, 0)]
    cli.main(["compare", *paths])
    assert "ncandidates" in capsys.readouterr().out
    points(spark, 3).write.parquet(f"{tmp_path}/data.parquet")
    points(spark, 3).selectExpr("vec_id AS qid", "embedding AS qv").write.parquet(f"{tmp_path}/queries.parquet")
    spark.createDataFrame([(0, [2, 1])], "qid long, knns array<long>").write.parquet(f"{tmp_path}/gt.parquet")
    assert sorted(map(tuple, catalogue(spark, str(tmp_path))["ground_truth"].collect())) == [(0, 1, 2), (0, 2, 1)]


def test_half_precision_and_gradients():
    from lodestone.functions.distance import half, softmax

    x = np.array([0.1, 1 / 3, 65504.0, 2.0**-24, 1e-9], np.float32)
    assert (half(x) == x.astype(np.float16).astype(np.float32)).all()
    rng = np.random.default_rng(0)
    net = MlpRouter([(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 2)), np.zeros(2))], [True, False], 2)
    data, labels = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    loss = lambda n: -np.log(softmax(n.logits(data))[np.arange(50), labels]).mean()
    trained = MlpRouter.fit(data, (data[:, 0] > 0).astype(int), 2, IndexConfig(layers=(("linear", 8), ("relu", 0)), train=TrainParams(epochs=200, batch_size=25)))
    assert loss(net) > 0 and (trained.probabilities(data).argmax(1) == (data[:, 0] > 0)).mean() > 0.9


def test_kmeans_ends_at_its_nearest_centres():
    from lodestone.operators.router import assigned, kmeans

    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(4) * 3, 25, 0) + 0.1 * rng.normal(size=(100, 4))
    for spherical in (False, True):
        labels = kmeans(x, 4, spherical, 20, 0)
        assert all(len(set(labels[25 * k : 25 * k + 25])) == 1 for k in range(4)) and len(set(labels)) == 4
    assert len(set(kmeans(np.zeros((5, 3)), 3, True, 5, 0))) == 1
    assert assigned(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]), False)[0] == 1


@pytest.fixture(scope="module")
def third(tmp_path_factory):
    """1207 rows: neither of the sizes that the SQL has the placement of."""
    folder = tmp_path_factory.mktemp("third")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < 1207) TO '{folder}/embeddings.parquet'")
    return str(folder)


def inserted(n: int) -> tuple[list[list[int]], list[int]]:
    """Levels and buffer of the fixture after n rows, one by one."""
    levels, buffer = [], []
    for i in range(n):
        buffer.append(i)
        if len(buffer) == 30:
            target = next((j for j, x in enumerate(levels) if 90 * 3**j - len(x) >= 30 + sum(map(len, levels[:j]))), len(levels))
            levels += [[]] * (target == len(levels))
            levels[: target + 1] = [*[[] for _ in range(target)], levels[target] + sum(levels[:target], []) + buffer]
            buffer = []
    return levels, buffer


def sql_with_placement(db, name: str, n: int) -> str:
    """The query's SQL with the placement of n rows in place of the literals of 500 and 2000."""
    levels, buffer = inserted(n)
    placed = pd.DataFrame([(i, level) for level, x in [*enumerate(levels), (-1, buffer)] for i in x], columns=["vec_id", "level"])
    sizes = pd.DataFrame([(i, 3 ** (i + 1)) for i in range(len(levels))], columns=["level", "nb"])
    db.register("placed_of", placed)
    db.register("lv_of", sizes)
    head, rest = registry.SQL[name].split("lv AS (", 1)
    own = "lv AS (SELECT * FROM lv_of),\nplace AS (SELECT vec_id, v, level FROM e JOIN placed_of USING (vec_id)),\ncen AS"
    return head + own + rest.split("\ncen AS", 1)[1]


#: The SQL of the rebuilds says which level moves where as well, which depends on the size.
PLACED = sorted(name for name, text in registry.SQL.items() if "lv AS (" in text and not name.startswith("rebuild"))


@pytest.mark.parametrize("name", PLACED)
def test_query_equals_sql_with_another_placement(spark, third, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{third}/embeddings.parquet'")
    a, b = registry.QUERIES[name](spark, third).toPandas(), db.sql(sql_with_placement(db, name, 1207)).df()
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_class_weights_of_every_row(spark, tmp_path):
    """Also beyond 10,000 rows, and where a weight ends in five."""
    n = 10_600
    spark.range(n).selectExpr("id AS vec_id", "CAST(IF(id < 1024, 0, IF(id < 1100, NULL, 1)) AS INT) AS label", "array(1f) AS embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(db.sql(registry.SQL["class_weights"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["class_weights"](spark, str(tmp_path)).collect()) == expected and len(expected) == n


def test_training_is_bounded_in_memory():
    from lodestone.operators.router import kmeans

    x = np.random.default_rng(0).normal(size=(12_000, 8))
    tracemalloc.start()
    labels = kmeans(x, 2000, True, 2, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(labels)) > 1500 and peak < 64 << 20  # rows by centres alone would be 192 MB


def test_exact_search_in_groups_keeps_queries_off_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from lodestone.operators import exact

    monkeypatch.setattr(exact, "NUMBERS", 1 << 9)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    x[300:] = x[:200]
    rows = vectors_of(spark, x.tolist())
    for k, alone in ((1, True), (7, False)):
        found = knn(rows, rows.selectExpr("vec_id AS qid", "embedding AS qv"), k, exclude_self=alone).collect()
        near = np.round(x.astype(float) @ x.astype(float).T, 9)
        if alone:
            np.fill_diagonal(near, -np.inf)
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]
        assert sorted((r["qid"], r["rank"] - 1, r["vec_id"]) for r in found) == [(i, j, best[i, j]) for i in range(500) for j in range(k)]


def test_search_parts_are_bounded_and_ask_once_a_query(spark, monkeypatch):
    from lodestone import index as module
    from lodestone.operators import exact

    parts = module.Parts.of(np.full(20_000, 30), 200)
    rows_of = np.bincount(parts.first, weights=np.full(20_000, 30))
    assert rows_of.max() <= 2 * module.PIECE and len(parts.sizes) <= 200
    batch = pa.RecordBatch.from_pydict({"qid": np.arange(40), "qv": [[1.0] * 64] * 40})
    asked = parts.questions(batch, np.repeat(np.arange(40), 20_000), np.tile(np.arange(20_000), 40), 1)
    assert asked.num_rows == len(parts.sizes) and asked.nbytes < 40 * len(parts.sizes) * 1000  # 400 MB with vectors beside each bucket
    monkeypatch.setattr(module, "FEW", 16)
    monkeypatch.setattr(exact, "NUMBERS", 30)
    rows, asked = points(spark, 159), points(spark, 159).selectExpr("vec_id AS qid", "embedding AS qv")
    index = VectorIndex(spark, TINY).insert(rows)
    assert sorted(index.search(asked, 5, None).collect()) == sorted(knn(rows, asked, 5, "l2").collect())
    chosen = {(r["qid"], r["level"], r["bucket"]) for r in index.candidates(asked, 40).collect()}
    at = {r["vec_id"]: (r["level"], r["bucket"]) if r["level"] >= 0 else (len(index.levels), sum(2 ** (i + 1) for i in range(len(index.levels)))) for r in index.records.collect()}
    for r in index.search(asked, 5, 40).collect():
        assert (r["qid"], *at[r["vec_id"]]) in chosen
