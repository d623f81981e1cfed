"""Extractive summaries: TF-IDF of sentences within a transcript, equal time sections, the best sentences of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.locators import citation
from ..functions.text import terms
from .segments import durations, sentences

DEFAULT_SECTIONS, MAX_SECTIONS = 5, 10
DEFAULT_SENTENCES, MAX_SENTENCES = 2, 5


def check_parameters(sections: int, per_section: int) -> None:
    if not 1 <= sections <= MAX_SECTIONS:
        raise ValueError(f"max_sections must be from 1 to {MAX_SECTIONS}")
    if not 1 <= per_section <= MAX_SENTENCES:
        raise ValueError(f"sentences_per_section must be from 1 to {MAX_SENTENCES}")


def term_freq(sents: DataFrame, key: str = "video_id") -> DataFrame:
    """key, sent_idx, term, first_pos, tf."""
    rows = sents.select(key, "sent_idx", F.posexplode(terms("text")).alias("pos", "term"))
    return rows.groupBy(key, "sent_idx", "term").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("tf"))


def doc_freq(tf: DataFrame, key: str = "video_id") -> DataFrame:
    """key, term, df: in how many sentences of its transcript a term is."""
    return tf.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"))


def scored(sents: DataFrame, key: str = "video_id") -> DataFrame:
    """sents with score: the sum of tf * (ln(N / df) + 1) over the sentence's terms, in order of first occurrence.

    Sentences come partitioned by transcript; counts within it are windows, so that nothing is exchanged again.
    """
    words = sents.select(key, "sent_idx", "start", "end", "text", F.posexplode_outer(terms("text")).alias("pos", "term"))
    first = [F.first(c).alias(c) for c in ("start", "end", "text")]
    tf = words.groupBy(key, "sent_idx", "term").agg(F.min("pos").alias("first_pos"), F.count("term").alias("tf"), *first)
    df = F.count(F.lit(1)).over(Window.partitionBy(key, "term"))
    n = F.max("sent_idx").over(Window.partitionBy(key)) + 1
    part = F.when(F.col("term").isNotNull(), F.col("tf") * (F.log(n / df) + 1))
    weighed = tf.withColumn("part", part)
    parts = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("first_pos", "part"))))
    return weighed.groupBy(key, "sent_idx").agg(*first, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))


def ranked(sents: DataFrame, key: str = "video_id") -> DataFrame:
    """scored, with rank: by score, then by place. Scores are compared at nine decimals, so ties are ties everywhere."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "sent_idx")
    return scored(sents, key).withColumn("rank", F.row_number().over(order))


def _section_start(i: Column, width: Column) -> Column:
    return i * width


def sectioned(segments: DataFrame, sections: int = DEFAULT_SECTIONS, key: str = "video_id") -> DataFrame:
    """Ranked sentences with section_no, section_start, section_end.

    Section i covers [i * width, (i + 1) * width); the last one has no upper bound. Bounds are compared as these
    products: a sentence is in the last section whose start it has reached.
    """
    return _with_sections(segments, sections, key).filter("section_no IS NOT NULL")


def _with_sections(segments: DataFrame, sections: int, key: str) -> DataFrame:
    """sectioned, and the sentences that have reached no section, whose section_no is null."""
    lengths = durations(segments, [key])
    rows = ranked(sentences(segments, key), key).join(lengths, key)
    rows = rows.withColumn("width", F.when(F.col("duration_seconds") > 0, F.col("duration_seconds") / sections).otherwise(0.0))
    reached = F.filter(F.sequence(F.lit(0), F.lit(sections - 1)), lambda i: _section_start(i, F.col("width")) <= F.col("start"))
    rows = rows.withColumn("section_no", F.array_max(reached))
    end = F.when(F.col("section_no") == sections - 1, F.col("duration_seconds")).otherwise(_section_start(F.col("section_no") + 1, F.col("width")))
    return rows.withColumn("section_start", _section_start(F.col("section_no"), F.col("width"))).withColumn("section_end", end)


def _best_of_sections(rows: DataFrame, per_section: int, key: str) -> DataFrame:
    """The best rows of each section, with section_index, which counts sections that have any."""
    inside = Window.partitionBy(key, "section_no").orderBy("rank")
    rows = rows.withColumn("place", F.row_number().over(inside))
    numbered = F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("section_no").asc_nulls_last())) - 1
    return rows.withColumn("section_index", numbered).filter(F.col("place") <= per_section)


def section_sentences(
    segments: DataFrame, sections: int = DEFAULT_SECTIONS, per_section: int = DEFAULT_SENTENCES, key: str = "video_id"
) -> DataFrame:
    """key, section_index, section_start, section_end, sent_idx, start, text: the best sentences of each section that has any."""
    check_parameters(sections, per_section)
    rows = _best_of_sections(sectioned(segments, sections, key), per_section, key)
    return rows.select(key, "section_index", "section_start", "section_end", "sent_idx", "start", "text")


def overall_sentences(segments: DataFrame, per_section: int = DEFAULT_SENTENCES, key: str = "video_id") -> DataFrame:
    """key, sent_idx, start, end, text, rank: the best sentences of the whole transcript."""
    rows = ranked(sentences(segments, key), key)
    return rows.filter(F.col("rank") <= per_section).select(key, "sent_idx", "start", "end", "text", "rank")


def summaries(
    segments: DataFrame, sections: int = DEFAULT_SECTIONS, per_section: int = DEFAULT_SENTENCES, key: str = "video_id"
) -> DataFrame:
    """One row per transcript: section_count, sections[index, start, end, sentences[text, start, url]], overall[text, start, url]."""
    cited = lambda: F.struct("sent_idx", "text", "start", citation(key, "start").alias("url"))
    plain = lambda c: F.transform(F.sort_array(c), lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["url"].alias("url")))
    # The best sentences of the whole are among those of their sections, so that one pass finds both.
    check_parameters(sections, per_section)
    rows = _best_of_sections(_with_sections(segments, sections, key), per_section, key)
    parts = rows.groupBy(key, "section_no", "section_index", "section_start", "section_end").agg(
        plain(F.collect_list(cited())).alias("sentences"), F.collect_list(F.when(F.col("rank") <= per_section, cited())).alias("top")
    )
    one = F.struct(F.col("section_index").alias("index"), F.col("section_start").alias("start"), F.col("section_end").alias("end"), "sentences")
    whole = parts.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("section_no").isNotNull(), one))).alias("sections"), plain(F.flatten(F.collect_list("top"))).alias("overall")
    )
    return whole.select(key, F.size("sections").alias("section_count"), "sections", "overall").filter("section_count > 0")
