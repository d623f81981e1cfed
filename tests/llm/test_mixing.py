from __future__ import annotations

import math
import re

import numpy as np
import pytest
from oracle import SMALL, sql_rows
from pyspark.sql import functions as F

from quillstream.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def iterated_targets(sizes, most=3):
    """Targets by resharing the excess again and again. sizes: by source in order."""
    total, free = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while free:
        rest = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in free)
        weight = sum(i % 3 + 1 for i in free)
        over = {i for i in free if (i % 3 + 1) * rest / weight > most * sizes[i]}
        for i in free:
            target[i] = most * sizes[i] if i in over else (i % 3 + 1) * rest / weight
        if not over:
            break
        free -= over
    return target


def run(spark, docs, **kw):
    return mixing.assignments(spark, docs, **kw).collect()


def check(rows, docs):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    per = {}
    for i, n in size.items():
        per[source[i]] = per.get(source[i], 0) + n
    order = sorted((s for s in per if s is not None)) + [None] * (None in per)
    targets = dict(zip(order, iterated_targets([per[s] for s in order]), strict=True))
    taken = dict.fromkeys(per, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s]
        assert math.isclose(r["target"], targets[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    return taken, targets


def test_table(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = run(spark, docs)
    taken, targets = check(rows, docs.collect())
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.02 * t
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, docs.repartition(7))))


def test_many_shards_and_levels(spark, frame, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 16)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    monkeypatch.setattr(mixing, "FAN_OUT", 4)
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", "big" if i % 2 else f"s{i % 5}", 0) for i in range(1500)]
    docs = frame(rows, DOCS)
    taken, targets = check(run(spark, docs), docs.collect())
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.01 * t + 5


def test_long_documents_have_their_share(spark, frame):
    # Quotas are 550 of 1,100 words, or none: the document of 800 words fits none of them.
    rows = [(40 * s + i, "w " * (20 if i else 800), "en", f"s{s:03}", 0) for s in range(600) for i in range(16)]
    docs = frame(rows, DOCS)
    got = run(spark, docs)
    taken, targets = check(got, docs.collect())
    sources = [s for s, t in targets.items() if t % 1100]
    extra = {(r["doc_id"] // 40, r["doc_id"] % 40): r["taken"] // r["size"] - int(r["target"] // 1100) for r in got if r["target"] % 1100}
    assert len(sources) == 400 and set(extra.values()) == {0, 1}
    assert 160 <= sum(n for (_, i), n in extra.items() if i == 0) <= 240
    assert 0.45 <= np.mean([n for (_, i), n in extra.items() if i]) <= 0.55
    assert abs(np.mean([taken[s] - targets[s] for s in sources])) <= 60


def test_odd_rows(spark, frame):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "x y z", "en", None, 0), (4, "x " * 50_000, "en", "b", 0), (5, "one two", "en", "é", 0), (None, "n m", "en", "b", 0)]
    docs = frame(rows, DOCS)
    check(run(spark, docs), docs.collect())
    assert run(spark, frame([], DOCS)) == [] and mixing.mixed_documents(spark, frame([], DOCS)).collect() == []
    twice = run(spark, frame([(1, "a b c", "en", "s", 0)] * 2, DOCS))
    assert len(twice) == 2 and len({r["taken"] for r in twice}) == 1
    assert [r["target"] for r in run(spark, frame([(1, "", "en", "s", 0)], DOCS))] == [0.0]


def test_mixed_documents(spark, frame):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("size", F.lit("x")).withColumn("times", F.lit(1))
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in run(spark, docs):
        if r["size"]:
            assert counts.get(r["doc_id"], 0) == r["taken"] // r["size"]


def test_hypergeometric_law(spark):
    key = F.col("id")
    draws = spark.range(4000).select(mixing._hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), key).alias("k"))
    seen = {r["k"]: r["count"] / 4000 for r in draws.groupBy("k").count().collect()}
    for k in range(11):
        p = math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(seen.get(k, 0) - p) < 0.03


def test_beyond_the_switch_is_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_SIGMA", 0.0)
    c = lambda x: F.lit(x).cast("long")
    draws = spark.range(50_000).select(mixing._hypergeometric(c(1000), c(100), c(100), F.col("id")).alias("k"))
    seen = {r["k"]: r["count"] / 50_000 for r in draws.groupBy("k").count().collect()}
    law = {k: math.comb(100, k) * math.comb(900, 100 - k) / math.comb(1000, 100) for k in range(101)}
    off = np.cumsum([seen.get(k, 0) - law[k] for k in range(101)])
    assert np.abs(off).max() < 1.63 / math.sqrt(50_000)


@pytest.mark.parametrize("total,mine,drawn", [(10**7, 4 * 10**6, 6 * 10**6), (3 * 10**8, 2 * 10**6, 10**8), (10**12, 10**11, 5 * 10**11)])
def test_large_shares_follow_the_law(spark, total, mine, drawn):
    c = lambda x: F.lit(x).cast("long")
    mean = drawn * mine / total
    sigma = math.sqrt(mean * (total - mine) / total * (total - drawn) / (total - 1))
    assert sigma > mixing.EXACT_SIGMA
    mode = (mine + 1) * (drawn + 1) // (total + 2)
    xs = [round(mode + z * sigma) for z in (-15, -3, -1, 0, 0.5, 2, 15)]
    frame = spark.createDataFrame([(x,) for x in [mode, *xs]], "x bigint")
    weights = {r["x"]: r["w"] for r in frame.select("x", mixing._log_weight(c(total), c(mine), c(drawn), F.col("x")).alias("w")).collect()}

    def ratio(x):
        """log p(x + 1) / p(x)"""
        return math.log((mine - x) * (drawn - x)) - math.log((x + 1) * (total - mine - drawn + x + 1))

    if sigma < 2000:  # sums over single steps
        for x in xs:
            steps = math.fsum(map(ratio, range(mode, x))) if x >= mode else -math.fsum(map(ratio, range(x, mode)))
            assert math.isclose(weights[x] - weights[mode], steps, abs_tol=1e-8)
    # The hat is above the law everywhere.
    width = 1.7155277699214135 * math.sqrt(sigma**2 + 0.5) + 0.8989161620588988
    assert all(abs(x + s - mean - 0.5) * math.exp((weights[x] - weights[mode]) / 2) <= width / 2 for x in xs for s in (0, 1))
    draws = np.array([r["k"] for r in spark.range(4000).select(mixing._hypergeometric(c(total), c(mine), c(drawn), F.col("id")).alias("k")).collect()])
    z = np.sort((draws + 0.5 - mean) / sigma)
    law = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    assert np.abs(law - np.arange(len(z)) / len(z)).max() < 1.63 / math.sqrt(len(z))
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


@pytest.mark.parametrize("total,mine,drawn", [(10, 0, 5), (10, 10, 5), (10, 4, 0), (10, 4, 10), (10**12, 10**11, 5 * 10**11), (7, 3, 6)])
def test_hypergeometric_bounds(spark, total, mine, drawn):
    c = lambda x: F.lit(x).cast("long")
    rows = spark.range(50).select(mixing._hypergeometric(c(total), c(mine), c(drawn), F.col("id")).alias("k")).collect()
    assert all(max(0, drawn - (total - mine)) <= r["k"] <= min(mine, drawn) for r in rows)


def test_sizes_and_targets_as_sql(spark):
    sql = r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, source FROM documents)
    SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT FROM d"""
    _, rows = sql_rows(sql, SMALL)
    found = {(r["doc_id"], r["size"], r["source_size"]) for r in run(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))}
    assert found == set(rows)


def unequal(frame):
    """Sources of 2000, 200 and 100 documents."""
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 40)), "en", "a" if i < 2000 else "b" if i < 2200 else "c", 0) for i in range(2300)]
    return frame(rows, DOCS)


def test_blocks_are_dealt_exactly(spark, frame, monkeypatch):
    for name, n in (("BLOCK_ROWS", 4), ("SHARD_BLOCKS", 16), ("FAN_OUT", 3), ("CELL_ROWS", 100)):
        monkeypatch.setattr(mixing, name, n)
    _, sources, _ = mixing._plan(unequal(frame), 20, 3)
    quota = {r["sid"]: r["epochs"] * r["blocks"] + r["thin"] for r in sources.collect()}
    dealt = mixing.output_shards(sources, 20).collect()
    total = sum(quota.values())
    shards = -(-total // 16)
    assert shards > 9 and all(quota.values())  # two levels at least
    # Every block of every source is in one shard, and every shard is full.
    for sid, n in quota.items():
        assert sorted(d for r in dealt if r["sid"] == sid for d in range(r["lo"], r["lo"] + r["n"])) == list(range(n))
    size = [sum(r["n"] for r in dealt if r["shard"] == k) for k in range(shards)]
    assert size == [(k + 1) * total // shards - k * total // shards for k in range(shards)]


def test_shares_of_a_shard_follow_the_law(spark, frame, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 10)
    kind = "sid bigint, epochs bigint, blocks bigint, thin bigint, cells bigint"
    sources = frame([(1, 1, 1200, 0, 1), (2, 0, 900, 540, 1), (3, 3, 420, 0, 1)], kind)
    # 300 shards of 10 blocks, out of 3000, of which 1200 are the source's; a shard without any has no row.
    seen = [r["n"] for r in mixing.output_shards(sources, 4).collect() if r["sid"] == 1]
    seen += [0] * (300 - len(seen))
    law = [math.comb(1200, k) * math.comb(1800, 10 - k) / math.comb(3000, 10) for k in range(11)]
    off = np.cumsum([seen.count(k) / 300 - law[k] for k in range(11)])
    assert np.abs(off).max() < 1.63 / math.sqrt(300) and sum(seen) == 1200


def test_every_shard_holds_all_sources(spark, frame):
    docs = unequal(frame)
    rows = run(spark, docs)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    held = {}
    for r in rows:
        for shard in r["out_shards"]:
            held.setdefault(shard, {}).setdefault(source[r["doc_id"]], []).append(r["size"])
    assert len(held) > 2
    taken = {s: sum(r["taken"] for r in rows if source[r["doc_id"]] == s) for s in "abc"}
    for shares in held.values():
        words = {s: sum(x) for s, x in shares.items()}
        assert set(words) == set("abc")
        for s in "abc":
            assert abs(words[s] / sum(words.values()) - taken[s] / sum(taken.values())) < 0.25


def test_mixed_documents_lie_as_dealt(spark, frame):
    docs = unequal(frame)
    dealt = {}
    for r in run(spark, docs):
        for shard in r["out_shards"]:
            dealt.setdefault(shard, []).append(r["doc_id"])
    parts = mixing.mixed_documents(spark, docs).withColumn("part", F.spark_partition_id()).collect()
    lists = [[r["doc_id"] for r in parts if r["part"] == p] for p in sorted({r["part"] for r in parts})]
    for ids in lists:  # a partition is its shards one after the other, each in an order of its own
        while ids:
            shard = next(k for k, held in dealt.items() if sorted(ids[: len(held)]) == sorted(held))
            held = dealt.pop(shard)
            assert ids[: len(held)] != sorted(held)
            ids = ids[len(held) :]
    assert not dealt
