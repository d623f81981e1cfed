from __future__ import annotations

import re

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from quillstream.llm import exact_dedup, runtime

ROWS = [
    (1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (9, "a", "en", "t", 1), (3, "A", "en", "s", 1), (4, "", "en", "s", 0), (5, None, "en", "s", None),
    (6, "x" * 200_000, "en", "s", 1), (7, "x" * 200_000, None, None, 1), (8, "b", "en", "s", 1), (8, "b", "en", "s", 1), (None, "c", "en", "s", 1), (None, "c", "en", "s", 1),
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")])
def test_copies_and_collisions(spark, frame, digest):
    docs = frame(ROWS, DOCS).repartition(4)
    got = exact_dedup.assignments(spark, docs, digest=digest).collect()
    want = expected(ROWS)
    by_id = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(want)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[by_id[r["doc_id"]]]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]


def test_kept_documents_have_their_columns(spark, frame):
    schema = DOCS + ", digest string, loc int, kept string, rec int"
    docs = frame([(*r, "d", 1, "k", 2) for r in ROWS], schema)
    kept = exact_dedup.distinct_documents(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(expected(ROWS))
    assert {r["source"] for r in kept.filter("text = 'a'").collect()} == {"t"}


def test_state_carries_over_micro_batches(spark, frame):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text")).repartition(9)
    one = exact_dedup.assignments(spark, docs, batches=1).orderBy("doc_id").collect()
    many = exact_dedup.assignments(spark, docs, batches=9).orderBy("doc_id").collect()
    assert [r.asDict() for r in one] == [r.asDict() for r in many]
    assert sum(r["kept"] for r in one) == 7


def test_texts_are_not_moved_beyond_the_bounds(spark, frame, monkeypatch):
    docs = frame([*ROWS, *[(k, f"text {k % 40}", "en", "s", 1) for k in range(100, 200)]], DOCS).repartition(5)
    want = sorted(map(str, exact_dedup.distinct_documents(spark, docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    kept = exact_dedup.distinct_documents(spark, docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not re.search("Exchange|Sort", plan)
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == want


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_a_second_delivery_is_checked_against_the_first(spark, frame, tmp_path, digest):
    first, second = ROWS, [(2, "b", "en", "s", 1), (20, "A", "en", "s", 1), (7, "new", "en", "s", 1), (6, "new", "en", "s", 1), (0, "a", "en", "s", 1), (30, None, "en", "s", 0)]
    run = lambda rows: exact_dedup.assignments(spark, frame(rows, DOCS).repartition(3), state_dir=str(tmp_path), digest=digest).collect()
    assert len(run(first)) == len(first)
    want = expected([*first, *second])
    got = {r["doc_id"]: r for r in run(second)}
    assert len(got) == len(second)
    for r in second:
        row = got[r[0]]
        assert (row["keep_id"], row["group_size"]) == want[r[1] or ""] and row["kept"] == (r[0] == row["keep_id"])
    # The same delivery again: all of it is known.
    again = run(second)
    assert {r["doc_id"]: r["group_size"] for r in again} == {r[0]: want[r[1] or ""][1] + sum((x[1] or "") == (r[1] or "") for x in second) for r in second}


def test_empty(spark, frame):
    assert exact_dedup.assignments(spark, frame([], DOCS)).count() == 0
    assert exact_dedup.distinct_documents(spark, frame([], DOCS)).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert exact_dedup.distinct_documents(spark, docs).count() == docs.select("text").distinct().count()
