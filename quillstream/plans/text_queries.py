"""Queries of segments, text functions, captions and locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locators, text
from ..operators import segments as seg
from ..sources import captions
from .registry import SEG, query, table

_ES_EN = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: Sentences of a column t in SQL.
SPLIT = r"list_filter(string_split(regexp_replace({t}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
TERMS = r"list_filter(regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+'), lambda w: w NOT IN (%s) AND length(w) > 1)"
STRIP_TEXT, SPLIT_TEXT = STRIP.format(t="text"), SPLIT.format(t="text")
TERMS_TEXT = TERMS % ("text", _ES_EN)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments_from_lines(table(spark, sf_dir, "documents"))


@query("segments_from_lines", f'WITH {SEG} SELECT video_id, lang, track_type, seg_idx, "start", "end", text FROM seg')
def segments_from_lines(spark, sf_dir):
    return segments(spark, sf_dir)


@query(
    "segments_from_snippets",
    f"""WITH {SEG} SELECT video_id, seg_idx, "start", "start" + (2.5::DOUBLE + seg_idx) AS "end", {STRIP_TEXT} AS text FROM seg""",
)
def segments_from_snippets(spark, sf_dir):
    snippets = segments(spark, sf_dir).select("video_id", "seg_idx", "start", (F.lit(2.5) + F.col("seg_idx")).alias("duration"), "text")
    return captions.segments_from_snippets(snippets)


@query(
    "segments_normalised",
    f"""WITH {SEG} SELECT video_id, lang, track_type, seg_idx, "start", "end", {STRIP_TEXT} AS text FROM seg WHERE {STRIP_TEXT} <> ''""",
)
def segments_normalised(spark, sf_dir):
    return seg.normalised(segments(spark, sf_dir))


@query(
    "segments_json_roundtrip",
    f"""WITH {SEG} SELECT video_id, count(*) AS n_segments, sum(length(text))::BIGINT AS chars, max("end") AS last_end FROM seg GROUP BY 1""",
)
def segments_json_roundtrip(spark, sf_dir):
    nested = seg.nest_segments(segments(spark, sf_dir)).select(*seg.TRACK_KEY, seg.to_json(F.col("segments")).alias("json"))
    back = seg.explode_segments(nested.withColumn("segments", seg.from_json(F.col("json"))))
    return back.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).alias("chars"), F.max("end").alias("last_end"))


@query("transcript_text", "SELECT doc_id::VARCHAR AS video_id, text FROM documents")
def transcript_text(spark, sf_dir):
    return seg.transcript_text(segments(spark, sf_dir), ["video_id"])


@query("transcript_duration", f'WITH {SEG} SELECT video_id, max("end") AS duration_seconds FROM seg GROUP BY 1')
def transcript_duration(spark, sf_dir):
    return seg.durations(segments(spark, sf_dir), ["video_id"])


@query(
    "duration_gate",
    f"""WITH {SEG} SELECT video_id, max("end") AS duration_seconds, CASE WHEN max("end") > 60 THEN 'duration_exceeded' END AS error_code
    FROM seg GROUP BY 1""",
)
def duration_gate(spark, sf_dir):
    return seg.duration_gate(segments(spark, sf_dir), ["video_id"], limit=60.0)


@query("est_tokens", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS est_tokens FROM documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.est_tokens("text").alias("est_tokens"))


@query(
    "ends_sentence",
    f"""WITH {SEG} SELECT video_id, seg_idx, regexp_matches({STRIP_TEXT}, '[.!?…]["''»”)\\]]*$') AS ends FROM seg""",
)
def ends_sentence(spark, sf_dir):
    return segments(spark, sf_dir).select("video_id", "seg_idx", text.ends_sentence("text").alias("ends"))


@query(
    "sentence_split",
    f"""SELECT doc_id, (unnest(range(len(s))))::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SPLIT_TEXT} AS s FROM documents)""",
)
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_sentences("text")).alias("pos", "sentence"))


@query("summary_terms", f"SELECT doc_id, {TERMS_TEXT} AS terms FROM documents")
def summary_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.terms("text").alias("terms"))


@query(
    "clean_markup",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text
    FROM pages""",
)
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_caption("html").alias("text"))


def _stamp(s: Column) -> Column:
    """Whole seconds as hh:mm:ss.mmm, milliseconds from the seconds."""
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, s % 1000)


_STAMP_SQL = "printf('%02d:%02d:%02d.%03d', {s} // 3600, ({s} // 60) % 60, {s} % 60, {s} % 1000)"


@query(
    "vtt_time",
    """SELECT event_id, (a // 3600 * 3600 + (a // 60) % 60 * 60 + a % 60)::DOUBLE + (a % 1000) / 1000.0::DOUBLE AS "start",
    (b // 60 * 60 + b % 60)::DOUBLE + (b % 1000) / 1000.0::DOUBLE AS "end"
    FROM (SELECT event_id, event_id AS a, event_id % 3000 AS b FROM events)""",
)
def vtt_time(spark, sf_dir):
    a, b = F.col("event_id"), F.col("event_id") % 3000
    short = F.format_string("%02d:%02d,%03d", F.floor(b / 60), b % 60, b % 1000)
    line = F.concat(_stamp(a), F.lit(" --> "), short, F.lit(" align:start"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", captions.seconds("line", 1).alias("start"), captions.seconds("line", 5).alias("end"))


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as caption files: a note, then a cue of two seconds per line, every third with a cue id and markup."""
    rows = segments(spark, sf_dir)
    n = F.col("seg_idx").cast("bigint")
    mark = F.when(n % 3 == 0, F.concat(F.lit("cue "), n.cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    body = F.when(n % 3 == 0, F.concat(F.lit("<c.x>"), "text", F.lit("</c>"))).otherwise(F.col("text"))
    cue = F.concat(mark, _stamp(n * 2), F.lit(" --> "), _stamp(n * 2 + 2), F.lit("\n"), body, F.lit("\n\n"))
    ordered = F.sort_array(F.collect_list(F.struct("seg_idx", cue.alias("cue"))))
    head = F.lit("WEBVTT\nKind: captions\nLanguage: en\n\nNOTE\nwritten by a test\n\n")
    content = F.concat(head, F.array_join(F.transform(ordered, lambda x: x["cue"]), ""))
    return rows.groupBy("video_id").agg(content.alias("content"))


_CLEAN = STRIP.format(t=r"regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
CUES = f"""cues AS (
  SELECT video_id, seg_idx::BIGINT AS n, {_CLEAN} AS clean, text FROM seg
)"""
_SECONDS = "(({s}) // 3600 * 3600 + ({s}) // 60 % 60 * 60 + ({s}) % 60)::DOUBLE + (({s}) % 1000) / 1000.0::DOUBLE"


@query(
    "vtt_blocks",
    f"""WITH {SEG}, l AS (
      SELECT video_id, seg_idx AS n, 1 AS k, 'x' AS line FROM seg WHERE seg_idx % 3 = 0
      UNION ALL SELECT video_id, seg_idx, 2, 'x' FROM seg
      UNION ALL SELECT video_id, seg_idx, 3, text FROM seg
      WHERE {STRIP_TEXT} <> '' OR seg_idx % 3 = 0)
    SELECT video_id, count(*) + 1 AS n_lines, count(DISTINCT n) + 1 AS n_blocks FROM l GROUP BY 1""",
)
def vtt_blocks(spark, sf_dir):
    blocks = captions.vtt_blocks(caption_files(spark, sf_dir))
    return blocks.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("block").alias("n_blocks"))


@query(
    "vtt_parse",
    f"""WITH {SEG}, {CUES} SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY n) - 1)::INTEGER AS seg_idx,
    {_SECONDS.format(s="n * 2")} AS "start", {_SECONDS.format(s="n * 2 + 2")} AS "end", clean AS text FROM cues WHERE clean <> ''""",
)
def vtt_parse(spark, sf_dir):
    return captions.parse_vtt(caption_files(spark, sf_dir))


def rolling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling captions from documents: every line is shown by half, then whole, then by half again."""
    half = F.left("text", F.ceil(F.length("text") / 2).cast("int"))
    shown = F.posexplode(F.array(half, F.col("text"), half)).alias("k", "shown")
    cues = segments(spark, sf_dir).select("video_id", "seg_idx", shown)
    number = F.col("seg_idx") * 3 + F.col("k")
    start = number.cast("double")
    return cues.select("video_id", number.alias("seg_idx"), start.alias("start"), (start + 1.5).alias("end"), F.col("shown").alias("text"))


_ROLLING = f"""
WITH {SEG}, h AS (SELECT video_id, seg_idx, text, left(text, ceil(length(text) / 2.0)::INTEGER) AS half FROM seg),
q AS (SELECT video_id, unnest([{{'n': seg_idx * 3, 't': half}}, {{'n': seg_idx * 3 + 1, 't': text}}, {{'n': seg_idx * 3 + 2, 't': half}}]) AS c FROM h),
c AS (SELECT video_id, list({{'t': c.t, 's': c.n::DOUBLE, 'e': c.n::DOUBLE + 1.5::DOUBLE}} ORDER BY c.n) AS cues FROM q GROUP BY 1),
f AS (SELECT video_id, list_reduce(list_transform(cues, lambda q: [q]), lambda acc, one:
    CASE WHEN starts_with(one[1].t, acc[-1].t) THEN list_append(acc[:-2], {{'t': one[1].t, 's': acc[-1].s, 'e': one[1].e}})
         WHEN starts_with(acc[-1].t, one[1].t) THEN list_append(acc[:-2], {{'t': acc[-1].t, 's': acc[-1].s, 'e': greatest(acc[-1].e, one[1].e)}})
         ELSE list_append(acc, one[1]) END) AS kept FROM c)
SELECT video_id, (unnest(range(len(kept))))::INTEGER AS seg_idx, unnest(kept).s AS "start", unnest(kept).e AS "end", unnest(kept).t AS text FROM f
"""


@query("rolling_dedup", _ROLLING)
def rolling_dedup(spark, sf_dir):
    return captions.rolling_dedup(rolling_cues(spark, sf_dir))


#: Watch URLs of many forms made from ids, and the pages' own URLs.
_URLS_SQL = """u AS (
  SELECT event_id, CASE event_id % 12
    WHEN 0 THEN 'https://www.youtube.com/watch?v=' || v WHEN 1 THEN 'https://youtu.be/' || v || '?t=3' WHEN 2 THEN ' http://m.youtube.com/watch?t=1&v=' || v || ' '
    WHEN 3 THEN 'https://youtube.com/shorts/' || v WHEN 4 THEN 'https://www.youtube.com/embed/' || v || '?rel=0' WHEN 5 THEN 'ftp://youtube.com/watch?v=' || v
    WHEN 6 THEN 'https://example.com/watch?v=' || v WHEN 7 THEN 'https://www.youtube.com/watch?v=' || v || '&list=PL1' WHEN 8 THEN 'https://www.youtube.com/live/' || v
    WHEN 9 THEN 'https://www.youtube.com/watch?v=' || v || 'x' WHEN 10 THEN '   ' ELSE 'https://www.youtube.com/feed' END AS url, v
  FROM (SELECT event_id, left('id-_' || event_id::VARCHAR || 'AbCdEfGhIjK', 11) AS v FROM events))"""
_REASON_SQL = """CASE event_id % 12 WHEN 5 THEN 'scheme' WHEN 6 THEN 'host' WHEN 7 THEN 'playlist' WHEN 8 THEN 'live'
    WHEN 9 THEN 'bad_id' WHEN 10 THEN 'empty' WHEN 11 THEN 'unrecognised' END"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    v = F.left(F.concat(F.lit("id-_"), F.col("event_id").cast("string"), F.lit("AbCdEfGhIjK")), F.lit(11))
    forms = [
        ("https://www.youtube.com/watch?v=", ""), ("https://youtu.be/", "?t=3"), (" http://m.youtube.com/watch?t=1&v=", " "),
        ("https://youtube.com/shorts/", ""), ("https://www.youtube.com/embed/", "?rel=0"), ("ftp://youtube.com/watch?v=", ""),
        ("https://example.com/watch?v=", ""), ("https://www.youtube.com/watch?v=", "&list=PL1"), ("https://www.youtube.com/live/", ""),
        ("https://www.youtube.com/watch?v=", "x"),
    ]
    k, url = F.col("event_id") % 12, F.lit("https://www.youtube.com/feed")
    url = F.when(k == 10, "   ").otherwise(url)
    for i, (head, tail) in enumerate(forms):
        url = F.when(k == i, F.concat(F.lit(head), v, F.lit(tail))).otherwise(url)
    return events.select("event_id", url.alias("url"))


@query(
    "video_id_extract",
    f"""WITH {_URLS_SQL} SELECT event_id, CASE WHEN event_id % 12 < 5 THEN v END AS video_id FROM u""",
)
def video_id_extract(spark, sf_dir):
    return urls(spark, sf_dir).select("event_id", locators.video_id("url").alias("video_id"))


@query(
    "url_reject_reason",
    f"""WITH {_URLS_SQL} SELECT event_id, url, {_REASON_SQL} AS reason FROM u
    UNION ALL SELECT -1 - page_id, url, 'host' FROM pages""",
)
def url_reject_reason(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.lit(-1) - F.col("page_id")).alias("event_id"), "url")
    return urls(spark, sf_dir).unionByName(pages).select("event_id", "url", locators.reject_reason("url").alias("reason"))


@query(
    "valid_id",
    """SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE regexp_full_match(w, '[A-Za-z0-9_-]{11}')) AS n_valid
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1""",
)
def valid_id(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(locators.is_valid_id("w")).alias("n_valid"))


@query(
    "citation_url",
    "SELECT event_id, 'https://www.youtube.com/watch?v=' || user_id::VARCHAR || '&t=' || trunc(value)::BIGINT::VARCHAR || 's' AS url FROM events",
)
def citation_url(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", locators.citation(F.col("user_id").cast("string"), "value").alias("url"))


@query(
    "job_key",
    """SELECT event_id, user_id::VARCHAR || ':' || CASE WHEN event_id % 2 = 0 THEN 'es+en' ELSE 'en' END AS job_id FROM events""",
)
def job_key(spark, sf_dir):
    languages = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("es"), F.lit("en"))).otherwise(F.array(F.lit("en")))
    key = text.job_id(F.col("user_id").cast("string"), text.lang_key(languages))
    return table(spark, sf_dir, "events").select("event_id", key.alias("job_id"))


@query(
    "match_query",
    r"""WITH b AS (SELECT item_id, text || ' "quoted" NEAR/x * ' || text AS q FROM benchmark),
    w AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(q, '\s+'), lambda x: replace(x, '"', '')),
      lambda x: regexp_matches(x, '[\p{L}\p{N}_]')) AS ws FROM b),
    u AS (SELECT item_id, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:32] AS t FROM w)
    SELECT item_id, '"' || array_to_string(t, '" OR "') || '"' AS match_query FROM u""",
)
def match_query(spark, sf_dir):
    asked = F.concat("text", F.lit(' "quoted" NEAR/x * '), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.match_query(asked).alias("match_query"))


@query(
    "best_format",
    """WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN [{'ext': 'json', 'url': url}, {'ext': 'vtt', 'url': url || '.vtt'}]
       WHEN 1 THEN [{'ext': 'vtt', 'url': ''}, {'ext': 'srt', 'url': url || '.srt'}] WHEN 2 THEN [{'ext': 'vtt', 'url': NULL}]
       ELSE [{'ext': 'vtt', 'url': url}, {'ext': 'vtt', 'url': 'second'}] END AS formats, url FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.vtt' WHEN 1 THEN url || '.srt' WHEN 2 THEN NULL ELSE url END AS best FROM f""",
)
def best_format(spark, sf_dir):
    one = lambda ext, url: F.struct(F.lit(ext).alias("ext"), url.alias("url"))
    url, k = F.col("url"), F.col("page_id") % 4
    formats = (
        F.when(k == 0, F.array(one("json", url), one("vtt", F.concat(url, F.lit(".vtt")))))
        .when(k == 1, F.array(one("vtt", F.lit("")), one("srt", F.concat(url, F.lit(".srt")))))
        .when(k == 2, F.array(one("vtt", F.lit(None).cast("string"))))
        .otherwise(F.array(one("vtt", url), one("vtt", F.lit("second"))))
    )
    return table(spark, sf_dir, "pages").select("page_id", captions.best_format(formats).alias("best"))
