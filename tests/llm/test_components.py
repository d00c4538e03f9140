import random

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import components as module


def reached(edges):
    """Each node of the edges and the least node it can reach, by plain code."""
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    moved = True
    while moved:
        moved = False
        for u, v in edges:
            if u != v and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                moved = True
    return label


def graph():
    """A long path in no order, a star, cliques, loops, repeats, both directions, and the ends of what 64 bits hold."""
    rng = random.Random(5)
    names = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
    edges = list(zip(names[:200], names[1:200])) + [(names[200], x) for x in names[201:260]]
    edges += [(a, b) for k in range(260, 300, 5) for a in names[k : k + 5] for b in names[k : k + 5]]
    edges += [(rng.choice(names[300:]), rng.choice(names[300:])) for _ in range(60)] + [(1, 1), (2**63 - 1, -(2**63)), (-(2**63), 2**63 - 1)]
    rng.shuffle(edges)
    return edges + edges[:50]


@pytest.mark.parametrize("alone", [module.ALONE, 0])
def test_components_by_plain_code(spark, monkeypatch, alone):
    monkeypatch.setattr(module, "ALONE", alone)
    frame = spark.createDataFrame(graph(), "u long, v long").repartition(4)
    rows = [tuple(r) for r in module.components(frame).collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == reached(graph())
    assert module.components(frame.where("u = v")).collect() == [] == module.components(frame.limit(0)).collect()


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    """A path of 2000 nodes took 13 checkpoints, each of some ten shuffles, whose files and logs filled check_h's disk."""
    cuts = []
    monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: cuts.append(1) or cut(df))
    path = spark.range(1, 2000).selectExpr("id u", "id - 1 v").repartition(4)
    assert {r["component"] for r in module.components(path).collect()} == {0}
    assert len(cuts) == 2


def test_contraction_bounds_what_it_holds(monkeypatch):
    monkeypatch.setattr(module, "ALONE", 40)
    edges = graph()
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(edges[k : k + 7], np.int64).T.copy()], ["u", "v"]) for k in range(0, len(edges), 7)]
    parts = list(module._contracted(iter(batches)))
    assert len(parts) > 2 and max(p.num_rows for p in parts) <= 47
    assert reached([tuple(e.values()) for p in parts for e in p.to_pylist()]) == reached(edges)
    assert [p.num_rows for p in module._contracted(iter([]))] == [0]
