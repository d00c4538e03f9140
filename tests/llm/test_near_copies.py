import random

import corpus_pipeline
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from lodestone.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def planted():
    """Texts of one long line with a few edits, some short, some around the bound, and many that share one passage."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    shared = rng.choices(words, k=40)
    texts = []
    for k in range(70):
        base = rng.choices(words, k=rng.choice([3, 6, 12, 60, 300]))
        if k % 3 == 0:
            base += shared
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append("  ".join(other).upper() if k % 5 == 0 else " ".join(other))
    return texts


@pytest.mark.parametrize("common", [1, 8])
def test_links_by_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    texts = planted() + [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = sorted(set(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    near = near_copies.components(near_copies.jaccard_edges(frame)).collect()
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 50
    for _ in range(len(texts)):
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert {r["node"]: r["component"] for r in near} == {k: label[k] for p in pairs for k in p}


def test_shingles_are_the_words():
    texts = [None, "", " a  B\tc ", "a b c d e f", "x a b c d e f", "one two"]
    found, sizes = near_copies.shingle_sets(pa.array(texts))
    assert sizes.tolist() == [len(shingles(t or "")) for t in texts]
    assert set(found[2 - 1 : 3].tolist()) < set(found[3:6].tolist()) | set(found.tolist())


def test_stage_drops_near_copies_that_simhash_misses(spark):
    rng = random.Random(2)
    rows, edits = [], [0, 1, 2, 3]
    for k in range(20):
        base = rng.choices([f"word{n}" for n in range(5000)], k=200)
        for e in edits:
            other = list(base)
            for n in range(e):
                other[50 * n + 20] = "changed"
            rows.append((4 * k + e, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == [4 * k for k in range(20)]


def test_stage_names_rows_without_an_id(spark):
    a, b = ("some words of a text that stands here more than once", "a wholly other text that stands here by itself and on its own")
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (7, b)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == [(0, a), (7, b)]
