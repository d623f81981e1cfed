"""Queries of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as seg
from ..operators import summarize
from .registry import SEG, query
from .text_queries import SPLIT_TEXT, STRIP_TEXT, TERMS_TEXT, segments

SENT = f"""{SEG}, sl AS (SELECT video_id, seg_idx, "start", "end", {SPLIT_TEXT.replace("text", "stripped")} AS ss
  FROM (SELECT *, {STRIP_TEXT} AS stripped FROM seg) WHERE stripped <> ''),
su AS (SELECT video_id, seg_idx, "start", "end", unnest(range(len(ss))) AS pos, unnest(ss) AS raw FROM sl),
sent AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, pos) - 1)::INTEGER AS sent_idx, "start", "end", text
  FROM (SELECT *, {STRIP_TEXT.replace("text", "raw")} AS text FROM su) WHERE text <> '')"""
TF = f"""{SENT}, tm AS (SELECT video_id, sent_idx, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM (SELECT video_id, sent_idx, {TERMS_TEXT} AS ts FROM sent)),
tf AS (SELECT video_id, sent_idx, term, min(pos) AS first_pos, count(*) AS tf FROM tm GROUP BY 1, 2, 3),
df AS (SELECT video_id, term, count(*) AS df FROM tf GROUP BY 1, 2)"""
SCORE = f"""{TF}, nn AS (SELECT video_id, count(*) AS n FROM sent GROUP BY 1),
sc AS (SELECT s.video_id, s.sent_idx, any_value(s."start") AS "start", any_value(s."end") AS "end", any_value(s.text) AS text,
  coalesce(list_sum(list(tf.tf * (ln(n::DOUBLE / df.df) + 1) ORDER BY first_pos) FILTER (WHERE tf.tf IS NOT NULL)), 0::DOUBLE) AS score
  FROM sent s JOIN nn USING (video_id) LEFT JOIN tf ON tf.video_id = s.video_id AND tf.sent_idx = s.sent_idx
  LEFT JOIN df ON df.video_id = tf.video_id AND df.term = tf.term GROUP BY s.video_id, s.sent_idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, sent_idx)::INTEGER AS rank FROM sc)"""
SECTION = f"""{SCORE}, du AS (SELECT video_id, max("end") AS d, max("end") / 5 AS w FROM seg GROUP BY 1),
se AS (SELECT rk.*, d, w, (CASE WHEN rk."start" >= 4 * w THEN 4 WHEN rk."start" >= 3 * w THEN 3 WHEN rk."start" >= 2 * w THEN 2 WHEN rk."start" >= w THEN 1 ELSE 0 END) AS sn
  FROM rk JOIN du USING (video_id)),
so AS (SELECT *, row_number() OVER (PARTITION BY video_id, sn ORDER BY rank) AS place, (dense_rank() OVER (PARTITION BY video_id ORDER BY sn) - 1)::INTEGER AS section_index FROM se)"""


@query("sentences", f'WITH {SENT} SELECT video_id, sent_idx, "start", "end", text FROM sent')
def sentences(spark, sf_dir):
    return seg.sentences(segments(spark, sf_dir))


@query("term_freq", f"WITH {TF} SELECT video_id, sent_idx, term, first_pos::INTEGER AS first_pos, tf FROM tf")
def term_freq(spark, sf_dir):
    return summarize.term_freq(seg.sentences(segments(spark, sf_dir)))


@query("doc_freq", f"WITH {TF} SELECT video_id, term, df FROM df")
def doc_freq(spark, sf_dir):
    return summarize.doc_freq(summarize.term_freq(seg.sentences(segments(spark, sf_dir))))


@query("sentence_tfidf", f"WITH {SCORE} SELECT video_id, sent_idx, round(score, 9) AS score FROM sc")
def sentence_tfidf(spark, sf_dir):
    rows = summarize.scored(seg.sentences(segments(spark, sf_dir)))
    return rows.select("video_id", "sent_idx", F.round("score", 9).alias("score"))


@query("summary_rank", f"WITH {SCORE} SELECT video_id, sent_idx, rank FROM rk")
def summary_rank(spark, sf_dir):
    return summarize.ranked(seg.sentences(segments(spark, sf_dir))).select("video_id", "sent_idx", "rank")


@query("summary_overall", f'WITH {SCORE} SELECT video_id, sent_idx, "start", "end", text, rank FROM rk WHERE rank <= 2')
def summary_overall(spark, sf_dir):
    return summarize.overall_sentences(segments(spark, sf_dir))


@query(
    "summary_sections",
    f"""WITH {SECTION} SELECT video_id, section_index, sn * w AS section_start, CASE WHEN sn = 4 THEN d ELSE (sn + 1) * w END AS section_end, sent_idx, "start", text
    FROM so WHERE place <= 2""",
)
def summary_sections(spark, sf_dir):
    return summarize.section_sentences(segments(spark, sf_dir))


@query(
    "summary_payload",
    f"""WITH {SECTION}, p AS (SELECT video_id, count(DISTINCT section_index)::INTEGER AS section_count, count(*) AS n_sentences,
      string_agg(text, chr(10) ORDER BY section_index, sent_idx) AS text FROM so WHERE place <= 2 GROUP BY 1),
    o AS (SELECT video_id, string_agg('https://www.youtube.com/watch?v=' || video_id || '&t=' || trunc("start")::BIGINT::VARCHAR || 's', ' ' ORDER BY sent_idx) AS urls
      FROM rk WHERE rank <= 2 GROUP BY 1)
    SELECT video_id, section_count, n_sentences, text, urls FROM p JOIN o USING (video_id)""",
)
def summary_payload(spark, sf_dir):
    rows = summarize.summaries(segments(spark, sf_dir))
    every = F.flatten(F.transform("sections", lambda s: s["sentences"]))
    return rows.select(
        "video_id",
        "section_count",
        F.size(every).cast("bigint").alias("n_sentences"),
        F.array_join(F.transform(every, lambda s: s["text"]), "\n").alias("text"),
        F.array_join(F.transform("overall", lambda s: s["url"]), " ").alias("urls"),
    )
