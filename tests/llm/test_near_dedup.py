from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from quillstream.llm import dart_minhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter({("\0", text or ""): 1})


def similar(a, b):
    common = sum((a & b).values())
    return 5 * common >= 4 * (sum(a.values()) + sum(b.values()) - common)


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(g) for g in groups.values())


def classes(spark, frame, rows):
    got = dart_minhash.near_duplicate_classes(spark, frame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(5)).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["class_id"]].append(r)
    for class_id, members in groups.items():
        assert sum(r["kept"] for r in members) == 1 and all(r["class_size"] == len(members) for r in members)
        assert class_id == min(r["doc_id"] for r in members)
    return sorted(sorted(r["doc_id"] for r in g) for g in groups.values())


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, base = [], [[word() for _ in range(rng.randint(60, 200))] for _ in range(8)]
    passage = [word() for _ in range(60)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:  # near copies, nearer and farther
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.8:  # a shared passage
            w = [word() for _ in range(rng.randint(5, 80))] + passage
        else:
            w = [word() for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_as_brute_force(spark, frame, seed):
    rows = corpus(seed)
    assert classes(spark, frame, rows) == brute_classes(rows)


def test_dense_cloud_in_small_chunks(spark, frame, monkeypatch):
    monkeypatch.setattr(dart_minhash, "CHUNK_NODES", 8)
    monkeypatch.setattr(dart_minhash, "LARGE", 10)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{i}_{rng.random()}"
        rows.append((i, " ".join(w)))
    assert classes(spark, frame, rows) == brute_classes(rows)


def test_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, TWO!"), (6, "one two three"), (7, "word " * 40_000), (8, "word " * 40_000 + "end"), (9, "same line\n" * 50), (10, "same line\n" * 49)]
    assert classes(spark, frame, rows) == brute_classes(rows)
    assert dart_minhash.near_duplicate_classes(spark, frame([], DOCS)).count() == 0
    docs = frame([(1, "a b c d e f", "en", "s", 0)] * 3 + [(None, "a b c d e f", "en", "s", 0)], DOCS)
    got = dart_minhash.near_duplicate_classes(spark, docs).collect()
    assert sum(r["kept"] for r in got) == 1 and {r["class_id"] for r in got} == {1}


def test_representatives(spark, frame):
    schema = DOCS + ", key string, bands int, loc string, rec int"
    docs = frame([(i, t, "en", "s", 0, "k", 1, "l", 2) for i, t in corpus(3, 60)], schema)
    kept = dart_minhash.representatives(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [g[0] for g in brute_classes(corpus(3, 60))]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    k = 4096
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    weights = rng.uniform(0.2, 3.0, (2, 60)) * (rng.random((2, 60)) < 0.8)

    def strips(w):
        seeds, cover = [], []
        for e, x in zip(elements, w, strict=True):
            for j in range(int(np.ceil(x))):
                seeds.append((int(e) + j * int(dart_minhash._OTHER)) % 2**64)
                cover.append(min(1.0, x - j))
        return dart_minhash.mix(np.array(seeds, np.uint64)), np.array(cover)

    (sa, ca), (sb, cb) = strips(weights[0]), strips(weights[1])
    owner = np.r_[np.zeros(len(sa), int), np.ones(len(sb), int)]
    sig = dart_minhash.signatures(np.r_[sa, sb], np.r_[ca, cb], owner, 2, k)
    exact = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs((sig[0] == sig[1]).mean() - exact) < 5 * (exact * (1 - exact) / k) ** 0.5


def test_darts_do_not_depend_on_the_bound():
    seeds = dart_minhash.mix(np.arange(1, 200).astype(np.uint64))
    low = dart_minhash.darts(seeds, np.full(199, 2.0))
    high = dart_minhash.darts(seeds, np.full(199, 90.0))
    below = high[1] < 2.0
    assert set(zip(low[0], low[2], strict=True)) == set(zip(high[0][below], high[2][below], strict=True))
    assert abs(len(high[0]) / 199 - 90) < 5
