from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.functions.schemas import TRANSCRIPT_ROW
from quillstream.operators import reading, summarize, tracks
from quillstream.sources import store

SEG = "video_id string, seg_idx int, start double, end double, text string"


def log(spark):
    rows = [
        ("v", "es", "manual", "es", "s", [], 100, 1),
        ("v", "es", "manual", "es", "s2", [], 200, 2),
        ("v", "es", "auto", "es", "s", [], 300, 3),
        ("w", "en", "manual", "", None, [], 50, 4),
    ]
    plain = TRANSCRIPT_ROW.replace("fetched_at timestamp", "t bigint")
    return spark.createDataFrame(rows, plain).withColumn("fetched_at", F.timestamp_seconds("t")).drop("t")


def at(s):
    return F.timestamp_seconds(F.lit(s))


def test_latest_and_ttl(spark):
    rows = log(spark)
    assert {(r["video_id"], r["track_type"], r["source"]) for r in store.latest(rows).collect()} == {("v", "manual", "s2"), ("v", "auto", "s"), ("w", "manual", None)}
    assert store.get(rows, at(300), 100, video_id="v", lang="es", track_type="manual").count() == 1  # exactly the age
    assert store.get(rows, at(301), 100, video_id="v", lang="es", track_type="manual").count() == 0
    assert store.fresh(rows, at(400), -1).count() == 0


def test_get_any_delete_replace_defaults(spark, tmp_path):
    rows = log(spark)
    newest = store.get_any(rows, at(300), 1000).collect()
    assert {(r["video_id"], r["write_seq"]) for r in newest} == {("v", 3), ("w", 4)}
    assert store.without(rows, rows.filter("video_id = 'v'")).count() == 1
    assert store.delete_matching(rows, video_id="v", track_type="auto", lang=None).count() == 3
    assert store.delete_matching(rows).count() == 4
    assert store.replace_keys(rows, rows.filter("write_seq = 2")).count() == 3
    assert {r["source"] for r in store.with_defaults(rows).collect()} == {"s", "s2", "youtube_captions"}
    store.append(rows, str(tmp_path / "log"))
    store.compact(store.read_log(spark, str(tmp_path / "log")), str(tmp_path / "new"), at(300), 1000)
    assert store.read_log(spark, str(tmp_path / "new")).count() == 3


def segments(frame):
    return frame([("v", 0, 0.0, 5.0, "inicio"), ("v", 1, 5.0, 10.0, "medio"), ("v", 2, 10.0, 15.0, "final")], SEG)


def test_read(frame):
    only = reading.read(segments(frame), 6.0, 9.0).first()
    assert only["text"] == "medio" and not only["truncated"]
    cut = reading.read(segments(frame), max_chars=4).first()
    assert cut["text"] == "inicio" and cut["truncated"]
    fill = reading.read(segments(frame), max_chars=12).first()
    assert fill["chars"] == 12 and fill["text"] == "inicio\nmedio" and fill["truncated"]
    assert reading.read(segments(frame), 100.0).count() == 0


def test_read_stops_at_the_first_segment_behind(frame):
    rows = frame([("v", 0, 0.0, 5.0, "a"), ("v", 1, 50.0, 55.0, "b"), ("v", 2, 6.0, 9.0, "c")], SEG)
    assert reading.read(rows, 0.0, 20.0).first()["text"] == "a"


@pytest.mark.parametrize("args", [(-1.0, None, 10), (5.0, 5.0, 10), (5.0, 4.0, 10), (0.0, None, 0)])
def test_invalid_ranges(args):
    with pytest.raises(reading.InvalidRange):
        reading.check_range(*args)


def pick(frame, pools, languages):
    rows = [("v", p, i, c) for i, (p, c) in enumerate(pools)]
    r = tracks.pick_track(frame(rows, "video_id string, pool string, track_pos int, code string"), languages).collect()
    return (r[0]["lang"], r[0]["track_type"]) if r else None


def test_pick_track(frame):
    assert pick(frame, [("auto", "es"), ("manual", "en")], ["es"]) == ("en", "manual")
    assert pick(frame, [("manual", "en"), ("manual", "es")], ["es", "en"]) == ("es", "manual")
    assert pick(frame, [("manual", "fr"), ("manual", "es-MX")], ["es"]) == ("es-MX", "manual")
    assert pick(frame, [("manual", "es-MX"), ("manual", "en")], ["es", "en"]) == ("en", "manual")
    assert pick(frame, [("auto", "de"), ("auto", "fr")], ["es"]) == ("de", "auto")
    assert pick(frame, [], ["es"]) is None


def outcome(frame, *tried):
    rows = [("v", f"p{i}", i, e, o, "blocked" if o == "failure" else None) for i, (o, e) in enumerate(tried)]
    r = tracks.first_success(frame(rows, "video_id string, provider string, priority int, enabled boolean, outcome string, error_code string")).first()
    return r and (r["status"], r["provider"], r["error_code"])


def test_first_success(frame):
    assert outcome(frame, ("empty", True), ("success", True)) == ("completed", "p1", None)
    assert outcome(frame, ("failure", True), ("success", True)) == ("error", None, "blocked")
    assert outcome(frame, ("rejected", True), ("success", False)) == ("error", None, "provider_unavailable")
    assert outcome(frame, ("rejected", True), ("empty", True)) == ("error", None, "no_captions")
    assert outcome(frame, ("success", False)) is None


def spoken(frame, texts):
    return frame([("v", i, 10.0 * i, 10.0 * (i + 1), t) for i, t in enumerate(texts)], SEG)


def test_summary_bounds(frame):
    row = summarize.summaries(spoken(frame, [f"Frase número {i} sobre tema{i}." for i in range(6)]), 3).first()
    assert row["section_count"] == 3 and row["sections"][0]["start"] == 0.0 and row["sections"][-1]["end"] == 60.0
    assert [s["index"] for s in row["sections"]] == [0, 1, 2]


def test_summary_drops_empty_sections(frame):
    rows = frame([("v", 0, 0.0, 1.0, "primera parte larga"), ("v", 1, 99.0, 100.0, "última parte larga")], SEG)
    row = summarize.summaries(rows, 10, 1).first()
    assert [s["sentences"][0]["text"] for s in row["sections"]] == ["primera parte larga", "última parte larga"]
    assert [s["index"] for s in row["sections"]] == [0, 1]


@pytest.mark.parametrize("args", [(0, 1), (11, 1), (1, 0), (1, 6)])
def test_summary_parameters(args):
    with pytest.raises(ValueError):
        summarize.check_parameters(*args)
