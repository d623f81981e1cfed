from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from oracle import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm import bpe, packing
from quillstream.llm.runtime import tokenizer_path

PATH, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(bpe.Vocabulary(PATH))
ODD = list("aab '  \n\t\r.,!1२½éÉßñ日本語stremvd") + ["'s", "'ll", "<|endoftext|>", "<|endoftext", "\x85", "\x1c", "\x0b", " ", "　", "﻿", "́", "²", "Ⅷ", "\U0001d4b3"]


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_as_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(4000)]
    assert [x.tolist() for x in CODEC.encode_batch(texts)] == library_ids(texts)
    for text in texts:
        assert CODEC.decode(CODEC.encode_batch([text])[0]) == LIBRARY.decode(library_ids([text])[0], skip_special_tokens=False) == text


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=80))
def test_any_text_as_the_library(text):
    assert CODEC.encode_batch([text])[0].tolist() == library_ids([text])[0]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "xyz", " " * 3000, "\n" * 2000 + "x", "".join(random.Random(1).choices("abcdefgh", k=9000)), ""])
def test_long_words(text):
    assert CODEC.encode_batch([text])[0].tolist() == library_ids([text])[0]


def test_long_words_together():
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlucmfw" * 3 + "éñ日", k=n)) for n in (1025, 30_000, 100_000, 2000)] + ["ab" * 50_000]
    ids = [np.frombuffer(x, "<i4").tolist() for x in CODEC._merge_long([w.encode() for w in words])]
    assert ids == library_ids(words)
    assert CODEC._merge_long([]) == []


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    codec = bpe.Codec(CODEC.v)
    texts = [f"word{i} again{i % 7} tail" for i in range(200)]
    assert [x.tolist() for t in texts for x in codec.encode_batch([t])] == library_ids(texts)
    assert len(codec.young) + len(codec.old) <= 40


def test_digests(spark, frame):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame([(-1, None), (-2, ""), (-3, "a<|endoftext|> b"), (None, "x y")], "doc_id bigint, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.digests(spark, docs.withColumn("ids", F.lit(1)), PATH).collect():
        ids = library_ids([texts[r["doc_id"]]])[0]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]])
    assert bpe.digests(spark, docs.limit(0), PATH).count() == 0


def test_general_operator(spark, frame):
    docs = frame([(1, "hello world"), (2, None)], "doc_id bigint, text string")
    got = {r["key"]["doc_id"]: r for r in bpe.encode_decode(spark, docs, PATH, F.struct("doc_id"), F.col("text")).collect()}
    assert got[1]["ids"] == library_ids(["hello world"])[0] and got[1]["decoded"] == "hello world"
    assert got[2]["ids"] == [] and got[2]["decoded"] == ""


def test_capacities():
    tree, rng, held = packing.Capacities(100), random.Random(2), []
    for _ in range(3000):
        if held and rng.random() < 0.5:
            room = held.pop(rng.randrange(len(held)))
            tree.add(room, -1)
        else:
            held.append(rng.randint(0, 100))
            tree.add(held[-1], 1)
        need = rng.randint(0, 100)
        assert tree.least(need) == min((r for r in held if r >= need), default=-1)


def slow_best_fit(lengths, top):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = [r for r in rows if r[0] >= lengths[i]]
        if fitting:
            row = min(fitting, key=lambda r: r[0])
        else:
            row = [top, []]
            rows.append(row)
        row[0] -= lengths[i]
        row[1].append(lengths[i])
    return sorted(r[0] for r in rows)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit_decreasing(lengths, 16)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths))) and all(len(r) <= 16 for r in rows)
    lengths = [x for x in lengths if x]
    rows = packing.best_fit_decreasing(lengths, 16)
    assert sorted(16 - sum(lengths[i] for i in r) for r in rows) == slow_best_fit(lengths, 16)


@pytest.mark.parametrize("seq_len,window", [(2048, 2_000_000), (16, 500)])
def test_packing_is_lossless(spark, frame, seq_len, window):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame([(-1, None), (-2, ""), (-3, "word " * 30_000)], "doc_id bigint, text string")).withColumn("ids", F.lit(1))
    rows = packing.pack(spark, docs, RANKS, seq_len, window).collect()
    found = packing.unpack(rows, seq_len)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(found) == set(texts)
    for doc, text in texts.items():
        assert found[doc].tolist() == library_ids([text])[0]
    for r in rows:
        assert len(r["ids"]) == 2 * seq_len and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= seq_len
        assert r["position_resets"] == sorted({a for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]) if b > a})
        assert not np.frombuffer(bytes(r["ids"]), "<u2")[r["n_tokens"] :].any()
    assert packing.pack(spark, docs.limit(0), RANKS).count() == 0


def test_empty_documents_do_not_pile_up(spark, frame, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_PIECES", 3000)
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").alias("text"))
    rows = packing.pack(spark, docs.unionByName(frame([(-1, "a b c")], "doc_id bigint, text string")), RANKS, 64).collect()
    assert sorted(d for r in rows for d in r["doc_ids"]) == list(range(-1, 100_000))
    assert max(len(r["doc_ids"]) for r in rows) <= 64 and sum(r["n_tokens"] for r in rows) == 3


def test_matrices_on_disk(spark, frame, tmp_path):
    docs = frame([(i, "some words here " * i) for i in range(20)], "doc_id bigint, text string")
    packing.write_matrices(packing.pack(spark, docs, RANKS, 64), str(tmp_path / "m"))
    assert set(packing.unpack(spark.read.parquet(str(tmp_path / "m")).collect(), 64)) == set(range(20))
