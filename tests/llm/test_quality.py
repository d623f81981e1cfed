from __future__ import annotations

import zlib

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F

from quillstream.llm import pu_quality

MEDIUM = SMALL.replace("0.001", "0.01")


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = pu_quality.scores(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([p == q for p, q in held]) >= 0.97
    assert np.mean([p for p, q in held if q == 1]) >= 0.98


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    plain = {r["doc_id"]: r["score"] for r in pu_quality.scores(spark, docs, labels).collect()}
    assert plain == {r["doc_id"]: r["score"] for r in pu_quality.scores(spark, docs, other).collect()}


def test_gradient_of_the_risk():
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.normal(1, 1, (2000, pu_quality.N_FEATURES)), np.vstack([rng.normal(1, 1, (1200, pu_quality.N_FEATURES)), rng.normal(-1, 1, (800, pu_quality.N_FEATURES))])
    model = pu_quality.fit(positive, unlabelled, 0.6, epochs=15)
    assert model.score(rng.normal(1, 1, (300, pu_quality.N_FEATURES))).mean() > 0.9
    assert model.score(rng.normal(-1, 1, (300, pu_quality.N_FEATURES))).mean() < 0.1


def test_slope_is_that_of_the_risk():
    rng = np.random.default_rng(2)
    for prior, shift in ((0.3, 0.0), (0.9, -1.0), (0.6, 0.5)):
        gp, gu = rng.normal(1, 1, 40), rng.normal(shift, 1, 60)
        g = np.r_[gp, gu]
        second = np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()
        brute = prior * np.log1p(np.exp(-gp)).mean() + max(0, second)
        assert np.isclose(pu_quality.risk(gp, gu, prior), brute)
        # Where the second part counts, it is the risk's slope; where it is negative, the other way along that part's.
        target = (lambda x: pu_quality.risk(x[:40], x[40:], prior)) if second >= 0 else (lambda x: prior * np.logaddexp(0, x[:40]).mean() - np.logaddexp(0, x[40:]).mean())
        steps = [(target(g + e) - target(g - e)) / 2e-5 for e in np.eye(100) * 1e-5]
        assert np.allclose(pu_quality.step_of(gp, gu, prior), steps, atol=1e-6)


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    n = pu_quality.N_FEATURES
    for prior in (0.2, 0.5, 0.8):
        some = int(4000 * prior)
        unlabelled = np.vstack([rng.normal(0.7, 1, (some, n)), rng.normal(-0.7, 1, (4000 - some, n))])
        assert abs(pu_quality.estimate_prior(rng.normal(0.7, 1, (3000, n)), unlabelled) - prior) < 0.04
    assert pu_quality.estimate_prior(unlabelled[:1], unlabelled) == 0.5


def test_negative_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    one, prior = pu_quality.learn(spark, docs, labels)
    other, same = pu_quality.learn(spark, docs, labels.filter("quality = 1"))
    assert prior == same and all(np.array_equal(a, b) for a, b in zip(one.w, other.w, strict=True))


def test_scales_are_of_all_documents(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    model, _ = pu_quality.learn(spark, docs, labels, train_rows=50)
    texts = [r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    f = pu_quality.features(texts).astype(np.float64)
    assert np.allclose(model.mean, f.mean(axis=0), atol=1e-4) and np.allclose(model.scale, f.std(axis=0) + 1e-3, atol=1e-4)


def test_repeated_ids_are_cut_alike(spark, frame):
    rows = [(1 + i % 3, f"word {i} " * (i % 50 + 1)) for i in range(3000)] + [(3, "same text")] * 500 + [(i, f"text {i}") for i in range(10, 1000)]
    docs, labels = frame(rows, "doc_id bigint, text string"), frame([(1, 1), (2, 1), (3, 1)], "doc_id bigint, quality int")
    one, _ = pu_quality.learn(spark, docs, labels, train_rows=100)
    other, _ = pu_quality.learn(spark, docs.repartition(7).orderBy(F.rand(5)), labels, train_rows=100)
    assert all(np.array_equal(a, b) for a, b in zip(one.w, other.w, strict=True))
    found = pu_quality._run_features(spark, docs.withColumnRenamed("doc_id", "id"), 200)
    assert len(found) == 200 and len(pu_quality._run_features(spark, docs.limit(0).withColumnRenamed("doc_id", "id"), 200)) == 0


def test_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "word " * 100_000), (None, "x"), (1, None), (4, "日本語 ñ")]
    docs = frame([(i, t, "score") for i, t in rows], "doc_id bigint, text string, score string")
    labels = frame([(3, 1), (4, 0), (3, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    got = pu_quality.scores(spark, docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert pu_quality.scores(spark, docs.limit(0), labels).count() == 0
    none = pu_quality.scores(spark, docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = pu_quality.accepted(spark, docs, labels)
    assert kept.columns == docs.columns
