from __future__ import annotations

import collections

from oracle import SMALL

import corpus_pipeline
from quillstream.llm import bpe, dart_minhash, mixing, pu_quality
from quillstream.llm.runtime import tokenizer_path


def test_stages_by_hand(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, now = docs.columns, docs
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, SMALL)
        made.write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        now = tables[-1]
        if k < 4:
            assert now.columns == columns
    quality, exact, near, mixed, ids = tables
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r["doc_id"] for r in pu_quality.scores(spark, docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in quality.collect()} == good
    newest = {}
    for r in quality.collect():
        newest[r["text"]] = max(r["doc_id"], newest.get(r["text"], -1))
    assert {r["doc_id"] for r in exact.collect()} == set(newest.values())
    kept = {r["doc_id"] for r in dart_minhash.near_duplicate_classes(spark, exact).filter("kept").collect()}
    assert {r["doc_id"] for r in near.collect()} == kept
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.assignments(spark, near).collect() if r["size"]}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: n for i, n in times.items() if n})
    codec = bpe.Codec(bpe.Vocabulary(tokenizer_path("byte_bpe_50k.json")))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = ids.collect()
    assert len(rows) == mixed.count()
    for r in rows:
        assert r["ids"] == codec.encode_batch([texts[r["doc_id"]]])[0].tolist() and r["n_tokens"] == len(r["ids"])
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in whole) == collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in rows)
