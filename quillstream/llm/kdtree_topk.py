"""Exact top-k inner-product search over sharded KD-trees.

Vectors are cut into cells by median splits, learnt from about ``SAMPLE_ROWS`` of them
(the cells only steer the search; its results are exact whatever they are). A cell of
more than ``SHARD_ROWS`` rows, of copies perhaps, is dealt by hash into shards. Every
shard builds one KD-tree: median splits on the widest dimension, and a tight bounding
box around the points of every node. The trees are written to the shared folder, with
the boxes of their roots beside them.

Queries of one cell are cut into blocks of about ``BLOCK_QUERIES``. A first pass searches
one tree of the block's own cell, which gives every query a kth score. Each block is
then held against the boxes of all shards, in chunks, and only the shards whose box can
reach the kth score of one of its queries are visited: a task holds one block and a
group of them, and takes the group's trees one at a time, carrying each query's kth
best score along. In a tree, the traversal is best-first: a heap of nodes, ordered by
the largest inner product that any point in the node's box can have; it ends when that
bound is below the query's kth score. Bounds that equal the kth score are still
visited, so ties go to the smaller id.

Components are integers, floor(scale * x). While no score can reach 2**53,
products are taken in float64, where they are exact; beyond, in Python integers,
and scores outside the range of a 64-bit integer count as its end.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; neither do null ids. Vectors only meet vectors of their own length,
however long. Rows that share the query's id are the query's own; if several rows ask
with one id, the shortest and then smallest vector asks; repeated rows of other ids
score each. Fewer candidates than k give fewer rows; an empty table gives none. Only the
two columns named, and what says whether a row asks, are read, so that others cannot
clash.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise, settings, ship_package

SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_QUERIES = 512
#: Vectors of one length that the cells are learnt from, about; and cells at most.
SAMPLE_ROWS, MOST_CELLS = 100_000, 4096
#: Shards that one task of the second pass visits, and boxes that a block is held against at once.
GROUP_SHARDS, CHUNK_BOXES = 8, 4096
_LONG = 2**63 - 1


def build_tree(ids: np.ndarray, points: np.ndarray) -> dict:
    """A KD-tree: nodes as arrays, points of a leaf side by side, in order of id within a leaf."""
    order = np.arange(len(ids))
    lo, hi, left, right, start, stop = [], [], [], [], [], []

    def add(a: int, b: int) -> int:
        own = points[order[a:b]]
        node = len(lo)
        lo.append(own.min(axis=0))
        hi.append(own.max(axis=0))
        left.append(-1)
        right.append(-1)
        start.append(a)
        stop.append(b)
        return node

    todo = [add(0, len(ids))]
    while todo:
        node = todo.pop()
        a, b = start[node], stop[node]
        spread = hi[node] - lo[node]
        axis = int(np.argmax(spread))
        if b - a <= LEAF_ROWS or spread[axis] == 0:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(points[order[a:b], axis], middle)]
        left[node], right[node] = add(a, a + middle), add(a + middle, b)
        todo += [left[node], right[node]]
    whole = {"lo": np.array(lo), "hi": np.array(hi), "points": points[order]}
    return {"ids": ids[order], "left": left, "right": right, "start": start, "stop": stop, **whole}


def exact_dtype(*arrays: np.ndarray) -> type:
    """float64 if all inner products, bounds included, are exact there; else Python integers."""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    wide = max((a.shape[-1] for a in arrays if a.ndim > 1), default=1)
    return np.float64 if 4 * top * top * max(1, wide) < 2**53 else object


def search_tree(tree: dict, queries: np.ndarray, own: np.ndarray, best: list[list[tuple[int, int, int]]], k: int) -> None:
    """Improve best, per query a heap of its k best (score, -id, 1 if found here)."""
    kind = exact_dtype(tree["points"], queries)
    q, points = queries.astype(kind), tree["points"].astype(kind)
    lo, hi = tree["lo"].astype(kind), tree["hi"].astype(kind)
    # Twice the largest inner product over a box: q(lo+hi) + |q|(hi-lo).
    bounds = (q @ (lo + hi).T + np.abs(q) @ (hi - lo).T) / 2 if kind is np.float64 else (q @ (lo + hi).T + np.abs(q) @ (hi - lo).T) // 2
    left, right, start, stop, ids = tree["left"], tree["right"], tree["start"], tree["stop"], tree["ids"]
    for i in range(len(q)):
        mine, row = best[i], bounds[i]
        nodes = [(-row[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if len(mine) == k and -bound < mine[0][0]:
                break
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    if len(mine) < k or row[child] >= mine[0][0]:
                        heapq.heappush(nodes, (-row[child], child))
                continue
            a, b = start[node], stop[node]
            scores = points[a:b] @ q[i]
            near = np.arange(b - a) if len(mine) < k else np.flatnonzero(scores >= mine[0][0])
            for j in near:
                if ids[a + j] != own[i]:
                    item = (max(-_LONG - 1, min(_LONG, int(scores[j]))), -int(ids[a + j]), 1)
                    if len(mine) < k:
                        heapq.heappush(mine, item)
                    elif item > mine[0]:
                        heapq.heapreplace(mine, item)


def _matrix(rows: pd.Series) -> np.ndarray:
    """Integer vectors as a matrix; Python integers where 64 bits don't hold them."""
    values = np.stack(rows.to_list()).astype(np.float64)
    if np.abs(values).max(initial=0) < 2.0**62:
        return values.astype(np.int64)
    return np.array([[int(x) for x in r] for r in values], dtype=object)


def median_cuts(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of the cuts of a complete binary tree, level by level: medians along the widest dimension."""
    axis, cut = np.zeros(2**depth - 1, np.int32), np.zeros(2**depth - 1)
    held = {0: points}
    for node in range(2**depth - 1):
        own = held.pop(node)
        if len(own):
            axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cut[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] >= cut[node]
        held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return axis, cut


def _cells(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with the number of their cell."""
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("n") / SHARD_ROWS)), F.lit(0)), F.lit(MOST_CELLS.bit_length() - 1)).cast("int")
    some = F.shiftrightunsigned(F.xxhash64(F.lit(3), "id", "v"), 11).cast("double") / 2.0**53 * F.col("n") < SAMPLE_ROWS
    # Copies count once, so that no vector, however frequent, makes a sample large.
    sample = rows.join(counts.withColumn("depth", depth).filter("depth > 0"), "dim").filter(some).select("dim", "depth", "v").distinct()

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        axis, cut = median_cuts(np.stack(frame["v"].to_list()).astype(np.float64), int(frame["depth"].iat[0]))
        return pd.DataFrame({"dim": [frame["dim"].iat[0]], "depth": [frame["depth"].iat[0]], "axis": [axis], "cut": [cut]})

    cuts = materialise(sample.groupBy("dim").applyInPandas(learn, "dim int, depth int, axis array<int>, cut array<double>"), "topk-cuts")
    first = F.lit(0)
    below = lambda node, _: node * 2 + 1 + (F.get("v", F.get("axis", node)) >= F.get("cut", node)).cast("int")
    node = F.aggregate(F.sequence(F.lit(1), F.col("depth")), first, below)
    cell = F.when(F.col("depth") > 0, node - F.size("axis")).otherwise(0)
    return rows.join(cuts, "dim", "left").withColumn("cell", F.coalesce(cell, F.lit(0)).cast("int")).drop("depth", "axis", "cut")


def _found(frame: pd.DataFrame, best: list[list[tuple[int, int, int]]]) -> pd.DataFrame:
    hits = [(q, s, -i) for q, heap in zip(frame["qid"], best, strict=True) for s, i, new in heap if new]
    return pd.DataFrame({"qid": [h[0] for h in hits], "vec_id": [h[2] for h in hits], "score": [h[1] for h in hits]}).astype("int64")


def reachable(queries: np.ndarray, kth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Numbers of the boxes that can hold a score of at least kth for one of the queries (kth of -inf: any)."""
    bounds = (queries @ (lo + hi).T + np.abs(queries) @ (hi - lo).T) / 2
    slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return np.flatnonzero((bounds + slack >= kth[:, None]).any(axis=0))


def top_k(
    spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score for every row of vectors that fulfils is_query."""
    ship_package(spark)
    usable = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() of a double is a long in SQL; beyond its range the product itself is whole.
    exact = F.transform(
        vector_col, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**62, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale)
    )
    rows = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & usable & (F.size(vector_col) > 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), exact.alias("v"), F.size(vector_col).alias("dim"), is_query.alias("asks"))
    rows = materialise(rows, "topk-vectors")
    counts = materialise(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "topk-counts")
    rows = materialise(_cells(rows, counts), "topk-cells")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(frame["id"].to_numpy(), _matrix(frame["v"]))
        box = [tree[c][0].astype(np.float64) for c in ("lo", "hi")]
        head = {c: [frame[c].iat[0]] for c in ("dim", "cell", "part")}
        return pd.DataFrame(head | {"lo": [box[0]], "hi": [box[1]], "tree": [pickle.dumps(tree, protocol=5)]})

    cells = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"))
    parts, blocks = F.ceil(F.col("n") / SHARD_ROWS).cast("int"), F.greatest(F.ceil(F.col("q") / BLOCK_QUERIES), F.lit(1)).cast("int")
    cells = materialise(cells.select("dim", "cell", parts.alias("parts"), blocks.alias("blocks")), "topk-sizes")
    placed = rows.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    trees = placed.select("dim", "cell", "part", "id", "v").groupBy("dim", "cell", "part")
    trees = trees.applyInPandas(build, "dim int, cell int, part int, lo array<double>, hi array<double>, tree binary")
    trees = materialise(trees.withColumn("shard", F.monotonically_increasing_id()), "topk-trees")

    asked = rows.filter("asks").groupBy("id").agg(F.min(F.struct("dim", "v", "cell")).alias("x")).select(F.col("id").alias("qid"), "x.*")
    block = F.pmod(F.xxhash64("qid", F.lit(2)), F.col("blocks")).cast("int")
    asked = materialise(asked.join(cells, ["dim", "cell"]).select("dim", "cell", block.alias("block"), "qid", "v"), "topk-asked")
    key = ["dim", "cell", "block"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []}).astype("int64")
        left = left.sort_values("qid")
        queries, own = _matrix(left["v"]), left["qid"].to_numpy()
        best: list[list[tuple[int, int, int]]] = [[] for _ in own]
        if "known" in left:
            for heap, known in zip(best, left["known"], strict=True):
                heap += [(int(x["score"]), -int(x["vec_id"]), 0) for x in (known if known is not None else [])]
                heapq.heapify(heap)
        for tree in right["tree"]:
            search_tree(pickle.loads(tree), queries, own, best, k)
        return _found(left, best)

    kind = "qid bigint, vec_id bigint, score bigint"
    own = materialise(asked.select(*key).distinct().withColumn("part", F.lit(0)), "topk-blocks")
    home = own.join(trees.select("dim", "cell", "part", "tree"), ["dim", "cell", "part"])
    # A hash may leave a cell's first shard empty; the block's queries then start without a kth score.
    first = materialise(asked.groupBy(*key).cogroup(home.groupBy(*key)).applyInPandas(search, kind), "topk-first")
    known = first.groupBy("qid").agg(F.collect_list(F.struct("vec_id", "score")).alias("known"))  # k at most
    asked = materialise(asked.join(known, "qid", "left"), "topk-known")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kth = [min(x["score"] for x in q["known"]) if q["known"] and len(q["known"]) == k else -np.inf for q in r["queries"]]
                boxes = r["boxes"]
                arrays = [np.array([x[c] for x in boxes]) for c in ("lo", "hi")]
                hit = reachable(np.array([q["v"] for q in r["queries"]]), np.array(kth, np.float64), *arrays)
                shards = pa.array([boxes[i]["shard"] for i in hit if (boxes[i]["cell"], boxes[i]["part"]) != (r["cell"], 0)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]] * len(shards), pa.int32()) for c in key), shards], [*key, "shard"])

    box = F.struct("shard", "cell", "part", "lo", "hi")
    chunks = trees.groupBy("dim", F.pmod(F.xxhash64("shard"), F.lit(-(-trees.count() // CHUNK_BOXES) or 1)).alias("chunk")).agg(F.collect_list(box).alias("boxes"))
    grouped = asked.groupBy(*key).agg(F.collect_list(F.struct("v", "known")).alias("queries"))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        pairs = grouped.join(chunks.drop("chunk"), "dim").select(*key, "queries", "boxes")
        pairs = materialise(pairs.mapInArrow(reach, "dim int, cell int, block int, shard bigint"), "topk-pairs")
    # Shards of a block in groups; a group carries the kth scores from tree to tree.
    order = F.row_number().over(Window.partitionBy(*key).orderBy("shard"))
    pairs = materialise(pairs.withColumn("grp", F.floor((order - 1) / GROUP_SHARDS).cast("int")), "topk-groups")
    met = pairs.join(trees.select("shard", "tree"), "shard")
    spread = asked.join(materialise(pairs.select(*key, "grp").distinct(), "topk-visits"), key)
    second = spread.groupBy(*key, "grp").cogroup(met.groupBy(*key, "grp")).applyInPandas(search, kind)
    every = first.unionByName(second)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
