from __future__ import annotations

import pytest

from quillstream.sources import audio, captions

PLAIN = """WEBVTT - weather report

1
00:00:01.000 --> 00:00:04.000 line:90%
Rain in the north,

2
00:00:04.000 --> 00:00:06.250
sun in the south
and wind on the coast.

01:00:00.000 --> 01:00:02.000
Good evening.
"""
#: Every cue repeats what the one before showed, with or without marks of its words.
ROLLING = """WEBVTT

NOTE made by hand

00:00:10.500 --> 00:00:11.000
<00:00:10.500><c> today</c> it

00:00:10.500 --> 00:00:12.000
today it rains

00:00:12.000 --> 00:00:14.000
today it rains a lot

00:00:14.000 --> 00:00:15.000
tomorrow
"""


def cues(frame, content):
    rows = captions.parse_vtt(frame([("v", content)], "video_id string, content string")).orderBy("seg_idx").collect()
    return [(r["start"], r["end"], r["text"]) for r in rows]


def test_plain(frame):
    assert cues(frame, PLAIN) == [(1.0, 4.0, "Rain in the north,"), (4.0, 6.25, "sun in the south and wind on the coast."), (3600.0, 3602.0, "Good evening.")]


@pytest.mark.parametrize("end", ["\n", "\r\n", " "])
def test_line_ends(frame, end):
    assert len(cues(frame, PLAIN.replace("\n", end))) == 3


def test_short_and_comma_times(frame):
    assert cues(frame, "00:05.000 --> 00:07.500\nx") == [(5.0, 7.5, "x")]
    assert cues(frame, "00:00:01,000 --> 00:00:02,000\nx") == [(1.0, 2.0, "x")]


def test_ids_notes_and_empty_cues(frame):
    content = "7\n00:01.000 --> 00:02.000\n<i></i>\n\nintro\n00:02.000 --> 00:03.000\nkept\nNOTE cut here\nlost"
    assert cues(frame, content) == [(2.0, 3.0, "kept")]
    assert cues(frame, "") == []


def test_rolling(frame, spark):
    parsed = captions.parse_vtt(frame([("v", ROLLING)], "video_id string, content string"))
    rows = captions.rolling_dedup(parsed).orderBy("seg_idx").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(10.5, 14.0, "today it rains a lot"), (14.0, 15.0, "tomorrow")]


def test_rolling_is_a_fold(frame):
    cue = [("v", i, float(i), i + 1.0, t) for i, t in enumerate(["ab", "a", "ac", "ac", "x"])]
    rows = captions.rolling_dedup(frame(cue, "video_id string, seg_idx int, start double, end double, text string")).orderBy("seg_idx").collect()
    assert [(r["text"], r["end"]) for r in rows] == [("ab", 2.0), ("ac", 4.0), ("x", 5.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(PLAIN)
    (tmp_path / "b.txt").write_text("no")
    rows = captions.read_caption_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["content"] == PLAIN


def test_snippets(frame):
    rows = captions.segments_from_snippets(frame([("v", 1.0, 2.5, " x ")], "video_id string, start double, duration double, text string")).collect()
    assert tuple(rows[0]) == ("v", 1.0, 3.5, "x")


def test_audio(spark, frame, tmp_path):
    (tmp_path / "v.wav").write_bytes(b"abc")
    (tmp_path / "v.txt").write_bytes(b"abc")
    files = audio.read_audio(spark, str(tmp_path))
    assert files.count() == 1
    rows = files.selectExpr("'v' AS video_id", "content").unionByName(frame([("w", bytearray(b""))], "video_id string, content binary"))

    def load():
        return lambda content, language: ("es", 0.9, [(0.0, 1.0, f" {len(content)} bytes ")] if content else [])

    made = {r["video_id"]: r for r in audio.transcribe(rows, load, "tiny").collect()}
    assert made["v"]["segments"][0]["text"] == "3 bytes" and made["v"]["error_code"] is None
    assert made["w"]["error_code"] == "asr_failed" and made["w"]["segments"] == []
