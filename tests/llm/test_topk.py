from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import kdtree_topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=10, step=10):
    usable = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    asks = {}
    for i, v in usable:
        if i % step == 0:
            asks[i] = min(asks.get(i, (len(v), v)), (len(v), v))
    for i, (_, q) in asks.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in usable if j != i and len(v) == len(q))
        out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return {i: x for i, x in out.items() if x}


def found(spark, frame, rows, k=10, step=10):
    df = kdtree_topk.top_k(spark, frame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % step == 0, k)
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("dim,shard,leaf", [(8, 100, 8), (3, 5000, 16), (1, 64, 4)])
def test_random(spark, frame, monkeypatch, dim, shard, leaf):
    monkeypatch.setattr(kdtree_topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(kdtree_topk, "LEAF_ROWS", leaf)
    monkeypatch.setattr(kdtree_topk, "BLOCK_QUERIES", 17)
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, dim), 2)]) for i in range(800)]
    assert found(spark, frame, rows) == brute(rows)


def test_ties_copies_and_odd_rows(spark, frame):
    rows = [(i, [0.5, -0.25]) for i in range(40)] + [(40, [0.5, -0.25]), (40, [0.5, -0.25]), (41, None), (42, [None, 1.0]), (43, [float("nan"), 1.0]), (44, [float("inf"), 1.0]),
            (45, []), (None, [1.0, 1.0]), (50, [1.0]), (60, [2.0]), (70, [1.0, 2.0, 3.0]), (46, [-3.0, 0.1])]
    assert found(spark, frame, rows) == brute(rows)


def test_huge_components(spark, frame):
    rows = [(0, [1e15, 1.0]), (1, [2e15, 1.0]), (2, [-3e15, 5.0]), (10, [3.0, 4.0])]
    assert found(spark, frame, rows) == brute(rows)


def test_empty(spark, frame):
    assert found(spark, frame, []) == {}
    assert found(spark, frame, [(1, [1.0])]) == {}


def test_boxes_are_tight():
    rng = np.random.default_rng(0)
    points = rng.integers(-9, 9, (500, 4))
    tree = kdtree_topk.build_tree(np.arange(500), points)
    for node in range(len(tree["start"])):
        own = tree["points"][tree["start"][node] : tree["stop"][node]]
        assert (own.min(axis=0) == tree["lo"][node]).all() and (own.max(axis=0) == tree["hi"][node]).all()


def test_far_shards_are_not_visited(spark, frame, monkeypatch):
    """Clusters far apart: a block only meets the shards near it, and the results are those of all."""
    for name, n in (("SHARD_ROWS", 50), ("BLOCK_QUERIES", 10), ("CHUNK_BOXES", 7), ("GROUP_SHARDS", 2)):
        monkeypatch.setattr(kdtree_topk, name, n)
    rng = np.random.default_rng(4)
    centres = np.array(list(itertools.product([-8.0, 8.0], repeat=4)))
    rows = [(i, [float(np.float32(x)) for x in centres[i // 7 % 16] + rng.normal(0, 0.1, 4)]) for i in range(1600)]
    visited, shards, plain = [], [], kdtree_topk.materialise

    def noted(df, what):
        made = plain(df, what)
        if what == "topk-trees":
            shards.append(made.count())
        if what == "topk-pairs":
            visited.append((made.count(), made.select("dim", "cell", "block").distinct().count()))
        return made

    monkeypatch.setattr(kdtree_topk, "materialise", noted)
    assert found(spark, frame, rows) == brute(rows)
    ((pairs, blocks),) = visited
    assert pairs < blocks * shards[0] / 4


def test_a_very_common_vector(spark, frame, monkeypatch):
    monkeypatch.setattr(kdtree_topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(kdtree_topk, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 else [float(np.float32(x)) for x in rng.normal(0, 1, 3)]) for i in range(600)]
    rows += [(i, [0.1 * i]) for i in range(600, 640)] + [(700, [1.0] * 5000), (701, [0.5] * 5000)]
    assert found(spark, frame, rows) == brute(rows)


def test_columns_that_clash(spark, frame):
    kind = "vec_id bigint, embedding array<float>, id string, v string, dim string, cell string, shard string, part string, n int"
    df = frame([(i, [float(i), 1.0], "a", "b", "c", "d", "e", "f", 1) for i in range(30)], kind)
    got = kdtree_topk.top_k(spark, df, F.col("vec_id") % 10 == 0, 3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 9


def test_reachable_misses_nothing():
    rng = np.random.default_rng(8)
    points = rng.integers(-50, 50, (40, 30, 3))
    points = points // 5 + rng.integers(-40, 40, (40, 1, 3))
    queries, kth = rng.integers(-50, 50, (6, 3)).astype(float), rng.integers(2500, 4000, 6).astype(float)
    hit = set(kdtree_topk.reachable(queries, kth, points.min(axis=1).astype(float), points.max(axis=1).astype(float)))
    need = {s for s in range(40) if ((queries @ points[s].T) >= kth[:, None]).any()}
    assert need <= hit and len(hit) < 40
