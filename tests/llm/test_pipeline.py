import collections

import corpus_pipeline
import duckdb
import numpy as np
from lodestone.llm import decontamination, packing, registry, simhash
from lodestone.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before
        if k < 4:
            assert docs.columns == names and (now < before or name == "near copies")
        else:
            assert now == before
        before = now


def test_edges_pass_through(spark, tmp_path):
    rows = [(None, None, "en", "s", None), (1, "", "en", "s", 0), (2, "some words of which there are quite a few in this line so it stays", None, None, 1), (2, "some words of which there are quite a few in this line so it stays", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert [r["doc_id"] for r in docs.collect()] == [2]


def test_clashing_names_null_ids_and_ties(spark, tmp_path):
    """Columns named like those inside the stages, ids that are null or recur, and an item in a row without id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = "the first of some words that stand here and of which there are quite a few in this line so that it stays in the end"
    rows = [(None, f"{plain} {item}"), (None, None), (5, plain), (5, plain), (5, plain.replace("quite", "rather").replace("line", "row")), (6, plain.upper()), (7, None), (8, "")]
    names = ["kept_id", "_id", "_row", "_", "a.b", "x y", "row", "chunk", "component_id", "n_words", "kept", "n_chars"]
    docs = spark.createDataFrame([(i, t, *(None if k % 2 else k for k in range(len(names) - 1)), 1) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        got = sorted((r["doc_id"] or 0) for r in docs.collect())
        assert got == {"quality rules": [0, 5, 5, 5, 6], "line dedup": [0, 5, 5, 5, 6], "near copies": [0, 5, 5], "decontamination": [5, 5], "packing": [5, 5]}[name], name


def test_rows_that_share_an_id_and_columns_of_any_type(spark, tmp_path):
    """Unrelated texts of one id all stay; of rows that are the same throughout one stays, also with columns that have no order."""
    a, b = ("some words of a text that stands here more than once", "a wholly other text that stands here by itself and on its own")
    rows = [(1, a, {"k": 1}, b"x"), (1, a, {"k": 1}, b"x"), (1, a, {"k": 2}, None), (1, b, None, b"y"), (2, b, {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, raw binary")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert sorted(got) == sorted([(1, a), (1, b)])


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_each_stage_by_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept: rules and lines by SQL, near copies, leaks and packing by plain code."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = docs.where("length(text) > 2000").orderBy("doc_id").first()["text"].replace("\n", " ")
    words = long.split()
    planted = [(90_001, long), (90_002, " ".join(["other", *words[1:]])), (90_003, long + " " + item), (90_004, " ".join(words[::-1]))]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    docs, folder = spark.read.parquet(f"{tmp_path}/in/documents.parquet"), f"{tmp_path}/in"
    texts = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    by_sql = lambda name, where: {r["doc_id"]: r for r in duckdb.sql(registry.SQL[name].replace("FROM documents", f"FROM '{where}/documents.parquet/*.parquet'")).df().to_dict("records")}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        if name == "quality rules":
            assert texts(docs) == {i: before[i] for i, r in by_sql("op7_quality_rules", folder).items() if r["kept"]}
        elif name == "line dedup":
            assert texts(docs) == {i: r["text"] for i, r in by_sql("op6_line_dedup", folder).items() if r["n_dropped"] == 0 or r["text"].split()}
        elif name == "near copies":
            ids = sorted(before)
            sets = []
            for i in ids:
                w = before[i].encode().lower().split()
                sets.append({tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set())
            prints = np.array([simhash.fingerprint(before[i]) for i in ids], np.uint64)
            label = list(range(len(ids)))
            for a in range(len(ids)):
                for b in range(a):
                    if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or bin(int(prints[a]) ^ int(prints[b])).count("1") <= 4:
                        x, y = label[a], label[b]
                        label = [min(x, y) if z in (x, y) else z for z in label]
            assert sorted(texts(docs)) == [i for k, i in enumerate(ids) if label[k] == k] and len(docs.collect()) < len(before)
        elif name == "decontamination":
            items = [decontamination.item_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = lambda words, have: sum(s in have for s in words) >= 0.8 * len(words)
            left = {}
            for i, t in before.items():
                have = decontamination.shingles(decontamination.item_words(t))
                parts = lambda w: [decontamination.shingles(p) for p in decontamination.parts(w)]
                if not any(held(decontamination.shingles(w), have) or all(held(p, have) for p in parts(w)) for w in items):
                    left[i] = t
            assert texts(docs) == left and 90_003 not in left
        else:
            t, found = Tokenizer.from_file(vocabulary(packing.VOCABULARY)), collections.Counter()
            for r in docs.collect():
                found[r["doc_id"]] += r["length"]
            assert found == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in before.items()}
        folder = f"{tmp_path}/{k}"
