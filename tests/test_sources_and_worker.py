from __future__ import annotations

import threading

import pytest

from quillstream.functions import sql
from quillstream.functions.schemas import JOB_ROW
from quillstream.operators import jobs
from quillstream.operators.tracks import first_success
from quillstream.sources import index, providers, store, workdirs
from quillstream.streaming import worker

SEG = "video_id string, lang string, track_type string, seg_idx int, start double, end double, text string"


def test_chain(spark, frame):
    snippets = frame([("a", "manual", 0, "es", i, float(i), 1.0, f" t{i} ") for i in range(3)], "video_id string, pool string, track_pos int, code string, seg_idx int, start double, duration double, text string")
    vtt = "WEBVTT\n\n00:00.000 --> 00:01.000\nhola\n\n00:01.000 --> 00:02.000\nhola mundo\n"
    files = frame([("b", "auto", 0, "es", vtt), ("c", "manual", 0, "en", "WEBVTT\n")], "video_id string, pool string, track_pos int, code string, content string")
    requests = frame([("a",), ("b",), ("c",)], "video_id string")
    chain = [*providers.default_chain(snippets, files), providers.ExternalAsrProvider()]
    rows = providers.within_limit(providers.candidates(requests, chain, ["es"]))
    found = {r["video_id"]: (r["status"], r["provider"], r["error_code"]) for r in first_success(rows).collect()}
    assert found == {"a": ("completed", "captions", None), "b": ("completed", "subtitles", None), "c": ("error", None, "no_captions")}
    texts = {r["video_id"]: [s["text"] for s in r["segments"]] for r in rows.filter("outcome = 'success'").collect()}
    assert texts == {"a": ["t0", "t1", "t2"], "b": ["hola mundo"]}
    too_long = providers.within_limit(rows, 1.0)
    assert {r["error_code"] for r in first_success(too_long).filter("video_id <> 'c'").collect()} == {"duration_exceeded"}
    refused = first_success(providers.candidates(requests, chain[:2], ["es"], rejected=["captions", "subtitles"])).collect()
    assert {r["error_code"] for r in refused} == {"provider_unavailable"}


def test_asr_provider(frame):
    files = frame([("a", bytearray(b"xy"), 10.0), ("b", bytearray(b""), 10.0), ("c", bytearray(b"x"), 9000.0)], "video_id string, content binary, duration double")

    def load():
        return lambda content, language: ("en", 0.5, [(0.0, 1.0, "said")] if content else [])

    rows = providers.AsrProvider(files, load, "size-a").fetch(frame([("a",), ("b",), ("c",)], "video_id string"), ["es"])
    assert {r["video_id"]: (r["outcome"], r["error_code"]) for r in rows.collect()} == {"a": ("success", None), "b": ("failure", "asr_failed"), "c": ("failure", "duration_exceeded")}


def test_index(spark, frame, tmp_path):
    made = index.Index(spark, str(tmp_path / "index"))
    assert made.chunks.count() == 0
    old = frame([("a", "es", "manual", i, 5.0 * i, 5.0 * i + 5, f"alpha numero {i} de la transcripcion.") for i in range(10)], SEG)
    assert made.ensure(old).count() == 1 and made.ensure(old).count() == 0
    (hit,) = made.search("alpha").collect()
    assert (hit["start"], hit["end"], hit["rank"]) == (0.0, 50.0, 1)
    new = frame([("b", "es", "manual", 0, 0.0, 5.0, "beta solo."), ("a", "es", "manual", 0, 0.0, 5.0, "gamma.")], SEG)
    assert [r["video_id"] for r in made.ensure(new).collect()] == ["b"]
    assert made.search("gamma").count() == 0  # a known transcript isn't indexed again ...
    made.replace(new)
    assert made.search("gamma").count() == 1 and made.search("alpha").count() == 0  # ... but for a replacement
    assert made.search("beta", video_id="a").count() == 0
    assert made.stats().first()["n_tokens"] == 3
    made.delete(video_id="b", lang=None)
    assert made.chunks.count() == 1 and tuple(made.stats().first())[:2] == (1, 1)
    made.compact()
    assert made.search("gamma").count() == 1 and made.manifest()["gone"] == []
    other = index.Index(spark, str(tmp_path / "index"))  # as after a restart
    assert other.chunks.collect() == made.chunks.collect()
    # What a crash leaves before the manifest is written is not read.
    made._write("chunks", made.manifest()["version"] + 1, made.chunks)
    assert made.chunks.count() == 1
    made.replace(new)
    assert made.chunks.count() == 2
    made.clear()
    assert made.chunks.count() == made.postings.count() == 0
    with pytest.raises(ValueError):
        made.search(" * ")


def test_worker(spark, frame, tmp_path):
    requests = frame([(f"{v}:es", v, "es") for v in "abc"], "job_id string, video_id string, lang_key string")
    table = jobs.enqueue(spark.createDataFrame([], JOB_ROW), requests, 0)
    codes = {"a": None, "b": "asr_failed", "c": "blocked"}
    count = iter(range(10**6))

    def kept(df):
        path = str(tmp_path / str(next(count)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def process(claimed):
        rows = [(r["job_id"], codes[r["video_id"]], "m") for r in claimed.collect() if r["video_id"] != "x"]
        return frame(rows, "job_id string, error_code string, error_message string")

    seen = {}
    for _ in range(3):
        table, changed = worker.step(table, process, 1_000, materialise=kept)
        (r,) = changed.collect()
        seen[r["video_id"]] = (r["status"], r["attempts"], r["next_attempt_us"])
    assert seen == {"a": ("completed", 1, 0), "b": ("failed", 1, 1_000), "c": ("pending", 1, 30_001_000)}
    table, changed = worker.step(table, process, 2_000, materialise=kept)
    assert changed.count() == 0 and table.count() == 3
    _, changed = worker.step(table, lambda claimed: process(claimed).limit(0), 40_000_000, many=5, materialise=kept)
    assert [(r["error_code"], r["attempts"]) for r in changed.collect()] == [("transcript_error", 2)]


def test_run_forever():
    stop, steps = threading.Event(), []

    def one():
        steps.append(1)
        if len(steps) == 3:
            stop.set()
        return len(steps) < 2

    worker.run_forever(one, 0.01, stop)
    assert len(steps) == 3


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT est_tokens('abcde') a, strip_blanks(' x ') b, split_sentences('Uno. Dos') c, is_video_id('Qx7-tb_0Zk9') d, citation_url('v', 620.9D) e").first()
    assert tuple(row) == (2, "x", ["Uno.", "Dos"], True, "https://www.youtube.com/watch?v=v&t=620s")


def test_store_keys():
    assert store.TRACK_KEY == ("video_id", "lang", "track_type")


def test_sweep(tmp_path):
    old, other = workdirs.new_work_dir(str(tmp_path)), tmp_path / "other"
    other.mkdir()
    (tmp_path / f"{workdirs.PREFIX}file").write_text("x")
    now = old.stat().st_mtime
    assert workdirs.sweep(str(tmp_path), 3600, now + 3600) == []
    assert workdirs.sweep(str(tmp_path), 3600, now + 3601) == [old] and other.exists()
    assert workdirs.sweep(str(tmp_path / "none")) == []
