"""License scan over a positional rare-token index, in DataFrame expressions only.

Templates are licence notices, given by their key phrases, all mandatory. Words of
phrases are counted over all documents, which gives every licence word its IDF. The
index holds postings (word, phrase, relative position): of every phrase those of the
word of highest IDF, and, in a second list, those of the next. A phrase can only
stand where its rarest words do, so common licence words are no keys of the index.

A file looks up its words of highest IDF, the keys, in both lists. Each posting found
proposes a place for a phrase (the word's position less its relative position); the
proposals of both lists are intersected, and at each place left all words of the
phrase are verified. A template is found when all its phrases are, in order and within
its window of words from the first.

The index and the templates are literals of the plan, whose size does not depend on
their number otherwise: nothing in it is repeated by template. Base phrases are
templates of one phrase, and all their places are counted. Nothing is exploded or
shuffled per document: a file's proposals are an array in its row. Only the counting
of licence words aggregates, with at most one row per word and task.

Defined results: a null or empty text has no words, no labels and score 0; its first
and last word are null. A very long text is read whole; its work grows with its words
and the places of phrases. Repeated rows give repeated results. Of words with the same
IDF the longer, then the first of a phrase is its rarer one. An empty table gives no
rows. Only the two columns named are read, so others cannot clash.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words. A-Z and a-z are word characters alike, so lower-casing first would cut the same words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence notice: key phrases, all mandatory, in order within `window` words from the first."""

    label: str
    phrases: tuple[str, ...]
    window: int = 0


# Base phrases with their labels.
BASE = (
    Template("mit", ("mit license",)),
    Template("apache", ("apache license",)),
    Template("gpl", ("general public license",)),
)
# Further licence notices by their key phrases.
NOTICES = (
    Template("mit-text", ("permission is hereby granted free of charge", "without restriction"), 60),
    Template("apache-2.0", ("apache license version 2 0",)),
    Template("apache-2.0", ("licensed under the apache license", "version 2 0"), 12),
    Template("gpl-2.0", ("gnu general public license version 2",)),
    Template("gpl-3.0", ("gnu general public license version 3",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("bsd", ("redistribution and use in source and binary forms", "with or without modification"), 20),
    Template("mpl-2.0", ("mozilla public license",)),
    Template("isc", ("permission to use copy modify and or distribute this software",)),
    Template("cc-by", ("licensed under cc by",)),
    Template("cc-by-nc", ("licensed under cc by nc",)),
    Template("cc-by-sa", ("licensed under cc by sa",)),
    Template("cc0", ("cc0 1 0 universal",)),
    Template("unlicense", ("this is free and unencumbered software released into the public domain",)),
)


def file_words(text: str | Column) -> Column:
    """Words as written."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _is_one_of(word: Column, vocabulary: list[str]) -> Column:
    """Whether the word with A-Z lower-cased is one of these plain words.

    lower() also changes other letters, a few of them to plain ones; but never without making the word shorter.
    """
    return F.lower(word).isin(vocabulary) & (F.octet_length(F.lower(word)) == F.octet_length(word))


def _phrases(templates: Sequence[Template]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(p.split()) for t in templates for p in t.phrases))


def inverse_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each licence word over all files; one number per word of the fixed vocabulary comes to the driver.

    words: a column `found` with the licence words of each file.
    """
    counted = words.select(F.explode(F.array_distinct("found")).alias("w")).groupBy("w").count()
    total = F.lit(None).cast("string")
    rows = counted.unionByName(words.select(total.alias("w")).groupBy("w").count()).collect()
    counts = {r["w"]: r["count"] for r in rows}
    n = counts.get(None, 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


class Index:
    """Postings and templates, as literals of a plan."""

    def __init__(self, templates: Sequence[Template], idf: dict[str, float], base: Sequence[Template] = BASE):
        phrases = _phrases(templates)
        number = {p: i for i, p in enumerate(phrases)}
        lists: list[dict[str, list[dict]]] = [{}, {}]
        for i, p in enumerate(phrases):
            rarest = sorted(range(len(p)), key=lambda k: (-idf[p[k]], -len(p[k]), k))  # noqa: B023
            for found, at in zip(lists, (rarest[0], rarest[min(1, len(p) - 1)]), strict=True):
                found.setdefault(p[at], []).append({"phrase": i, "at": at})
        self.keys = sorted({w for found in lists for w in found})
        self.lists = [_literal(found, "map<string, array<struct<phrase: bigint, at: int>>>") for found in lists]
        self.phrases = _literal([" ".join(p) for p in phrases], "array<string>")
        self.lengths = _literal([len(p) for p in phrases], "array<int>")
        starting: list[list[dict]] = [[] for _ in phrases]
        weights = [sum(idf[w] for p in t.phrases for w in p.split()) for t in templates]
        most = max(weights, default=0.0) or 1.0
        for k, t in enumerate(templates):
            first, *rest = [number[tuple(p.split())] for p in t.phrases]
            starting[first].append({"template": k, "rest": rest, "window": t.window})
        self.starting = _literal(starting, "array<array<struct<template: int, rest: array<bigint>, window: int>>>")
        about = [{"label": t.label, "base": t in base, "score": 0.5 + 0.5 * w / most} for t, w in zip(templates, weights, strict=True)]
        self.about = _literal(about, "array<struct<label: string, base: boolean, score: double>>")
        #: Phrases that can begin at one place.
        self.together = max(Counter(p[0] for p in phrases).values(), default=1)


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _lowered(word: Column) -> Column:
    """A-Z lower-cased; a word that lower() changes otherwise is no licence word either way."""
    return F.when(F.octet_length(F.lower(word)) == F.octet_length(word), F.lower(word)).otherwise(word)


def _proposals(postings: Column) -> Column:
    """phrase * 2**40 + start, as proposed by the words in `rare`."""

    def of(x: Column) -> Column:
        here = F.filter(F.try_element_at(postings, x["w"]), lambda e: e["at"] <= x["pos"])
        return F.transform(here, lambda e: F.shiftleft(e["phrase"], 40) + (x["pos"] - e["at"]))

    return F.flatten(F.array_compact(F.transform("rare", of)))


def scan(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = BASE + NOTICES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    templates = list(dict.fromkeys(templates))
    vocabulary = sorted({w for p in _phrases(templates) for w in p})
    licence_words = F.filter(file_words(text_col), lambda w: _is_one_of(w, vocabulary))
    idf = inverse_frequencies(docs.select(F.transform(licence_words, F.lower).alias("found")), vocabulary)
    index = Index(templates, idf)
    words = docs.select(F.col(id_col).alias("doc_id"), file_words(text_col).alias("words"))
    entry = lambda w, i: F.struct(i.cast("bigint").alias("pos"), w.alias("w"))
    rare = F.filter(F.transform("words", entry), lambda x: _is_one_of(x["w"], index.keys))
    rare = F.transform(rare, lambda x: F.struct(x["pos"].alias("pos"), F.lower(x["w"]).alias("w")))
    none = F.array().cast("array<struct<pos: bigint, w: string>>")
    rare = F.when(F.exists("words", lambda w: _is_one_of(w, index.keys)), rare).otherwise(none)
    rows = words.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", rare.alias("rare"))
    agreed = F.array_intersect(*[_proposals(x) for x in index.lists])
    places = F.transform(agreed, lambda v: F.struct((v % 2**40).cast("int").alias("start"), F.shiftright(v, 40).cast("int").alias("phrase")))

    def stands(h: Column) -> Column:
        there = F.slice(F.col("words"), h["start"] + 1, F.get(index.lengths, h["phrase"]))
        return F.array_join(F.transform(there, _lowered), " ") == F.get(index.phrases, h["phrase"])

    hits = F.sort_array(F.filter(places, stands))
    no_hits = F.array().cast("array<struct<start: int, phrase: int>>")
    rows = rows.select("doc_id", "n_words", F.when(F.size("rare") > 0, hits).otherwise(no_hits).alias("hits"))

    def found(h: Column, j: Column) -> Column:
        def follows(t: Column) -> Column:
            near = F.slice("hits", j + 2, t["window"] * index.together)
            behind = lambda y: (y["start"] > h["start"]) & (y["start"] <= h["start"] + t["window"])
            return F.forall(t["rest"], lambda r: F.exists(near, lambda y: (y["phrase"] == r) & behind(y)))

        own = F.filter(F.get(index.starting, h["phrase"]), follows)
        return F.transform(own, lambda t: F.struct(h["start"].alias("start"), F.get(index.about, t["template"]).alias("about")))

    nothing = F.array().cast("array<struct<start: int, about: struct<label: string, base: boolean, score: double>>>")
    matches = F.when(F.size("hits") > 0, F.flatten(F.transform("hits", found))).otherwise(nothing)
    rows = rows.select("doc_id", "n_words", matches.alias("matches"))
    base = F.filter("matches", lambda m: m["about"]["base"])
    starts = F.transform(base, lambda m: m["start"])
    label = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["about"]["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["about"]["score"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        label(base).alias("base_labels"),
        label("matches").alias("labels"),
        F.round(score, 6).alias("score"),
    )


def oracle_sql(table: str = "documents") -> str:
    """The scan by looking at every place of every file, in DuckDB's SQL."""
    templates = list(dict.fromkeys(BASE + NOTICES))
    vocabulary = sorted({w for t in templates for p in t.phrases for w in p.split()})
    text = lambda x: "'" + x + "'"

    def places(phrase: str) -> str:
        ws = phrase.split()
        there = " AND ".join(f"ws[i + {k}] = {text(w)}" for k, w in enumerate(ws))
        return f"list_filter(range(1, len(ws) - {len(ws) - 2}), lambda i: {there})"

    def template(t: Template) -> str:
        first, *rest = map(places, t.phrases)
        for r in rest:
            first = f"list_filter({first}, lambda s: len(list_filter({r}, lambda r: r > s AND r <= s + {t.window})) > 0)"
        return first

    columns = ", ".join(f"{template(t)} AS t{k}" for k, t in enumerate(templates))
    found = lambda ks: ", ".join(f"CASE WHEN len(t{k}) > 0 THEN {text(templates[k].label)} END" for k in ks)
    labels = lambda ks: f"array_to_string(list_sort(list_distinct(list_filter([{found(ks)}], lambda x: x IS NOT NULL))), ',')"
    base, every = range(len(BASE)), range(len(templates))
    places_of_base = " || ".join(f"t{k}" for k in base)
    words = ", ".join(f"({k}, {text(w)})" for k, t in enumerate(templates) for p in t.phrases for w in p.split())
    weights = ", ".join(f"CASE WHEN len(t{k}) > 0 THEN 0.5 + 0.5 * (SELECT x FROM share WHERE t = {k}) ELSE 0 END" for k in every)
    return f"""
    WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {text(_UPPER)}, {text(_LOWER)}),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {table}),
    n AS (SELECT count(*)::DOUBLE AS n FROM w),
    df AS (SELECT v, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(ws)) AS v FROM w) WHERE v IN ({", ".join(map(text, vocabulary))}) GROUP BY 1),
    used(t, v) AS (VALUES {words}),
    weight AS (SELECT t, sum(ln((n + 1) / (coalesce(df, 0) + 1))) AS x FROM used CROSS JOIN n LEFT JOIN df USING (v) GROUP BY t),
    share AS (SELECT t, x / coalesce(nullif((SELECT max(x) FROM weight), 0), 1) AS x FROM weight),
    f AS (SELECT doc_id, ws, {columns} FROM w)
    SELECT doc_id, len(ws)::BIGINT AS n_words, len({places_of_base})::BIGINT AS n_base, list_min({places_of_base})::BIGINT - 1 AS first_word,
      list_max({places_of_base})::BIGINT - 1 AS last_word, {labels(base)} AS base_labels, {labels(every)} AS labels, round(greatest({weights}), 6)::DOUBLE AS score FROM f
    """
