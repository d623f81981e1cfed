"""Queries of chunking and search. Chunks are small (50 to 100 tokens), so that most documents have several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, search
from ..operators.segments import normalised, segments_from_lines, transcripts_from_lines
from ..sources import store
from .registry import SEG, query, table
from .text_queries import SPLIT_TEXT, STRIP_TEXT, segments

MIN, MAX, OVERLAP = 50, 100, 0.12

_SPLIT_S = "list_transform(range(0, length(s), 400), lambda i: substring(s, i + 1, 400))"
#: Units of segments, in SQL.
UNITS = f"""{SEG}, norm AS (SELECT video_id, lang, track_type, seg_idx, "start", "end", {STRIP_TEXT} AS text FROM seg WHERE {STRIP_TEXT} <> ''),
ps AS (SELECT *, ceil(length(text) / 4.0) > 100 AS over, CASE WHEN ceil(length(text) / 4.0) <= 100 THEN [text] ELSE
  flatten(list_transform({SPLIT_TEXT}, lambda s: CASE WHEN ceil(length(s) / 4.0) <= 100 THEN [s] ELSE {_SPLIT_S} END)) END AS pieces FROM norm),
un AS (SELECT video_id, lang, track_type, seg_idx, "start" AS s0, "end" AS e0, over, (unnest(range(len(pieces))))::INTEGER AS pos, unnest(pieces) AS text FROM ps),
cu AS (SELECT *, sum(length(text)) OVER (PARTITION BY video_id, seg_idx ORDER BY pos)::DOUBLE AS upto, sum(length(text)) OVER (PARTITION BY video_id, seg_idx)::DOUBLE AS total FROM un),
units AS (SELECT video_id, lang, track_type, seg_idx, pos, text, CASE WHEN over THEN s0 + greatest(e0 - s0, 0) * ((upto - length(text)) / total) ELSE s0 END AS "start",
  CASE WHEN over THEN s0 + greatest(e0 - s0, 0) * (upto / total) ELSE e0 END AS "end" FROM cu)"""


def chunks_sql(overlap: float, text: str = "text") -> str:
    """CTEs that end with chunks, by look-ups over prefix sums and one recursive chain."""
    return f"""RECURSIVE {UNITS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, pos) AS i, ceil(length(text) / 4.0)::BIGINT AS t,
  regexp_matches(text, '[.!?…]["''»”)\\]]*$') AS closes FROM units),
p AS (SELECT video_id, i AS k, sum(t) OVER (PARTITION BY video_id ORDER BY i)::BIGINT AS p, closes FROM ordered UNION ALL SELECT DISTINCT video_id, 0, 0, false FROM ordered),
n AS (SELECT video_id, max(k) AS n FROM p GROUP BY 1),
fu AS (SELECT a.video_id, a.k AS s, a.p AS ps, max(b.k) AS fu FROM p a JOIN p b ON a.video_id = b.video_id AND b.k > a.k AND (b.p - a.p <= {MAX} OR b.k = a.k + 1) GROUP BY ALL),
cl AS (SELECT fu.*, q.closes, (SELECT max(b.k) FROM p b WHERE b.video_id = fu.video_id AND b.k > fu.s AND b.k < fu.fu AND b.closes AND b.p - fu.ps >= {MIN}) AS back
  FROM fu JOIN p q ON q.video_id = fu.video_id AND q.k = fu.fu),
en AS (SELECT video_id, s, ps, CASE WHEN closes THEN fu ELSE coalesce(back, fu) END AS e FROM cl),
step AS (SELECT en.*, q.p AS pe, (SELECT min(b.k) FROM p b WHERE b.video_id = en.video_id AND b.k > en.s AND b.k <= en.e
  AND (q.p - b.p)::DOUBLE <= (q.p - en.ps)::DOUBLE * {overlap}::DOUBLE) AS nxt FROM en JOIN p q ON q.video_id = en.video_id AND q.k = en.e),
chain AS (SELECT step.video_id, 0 AS chunk_index, s, e, pe - ps AS tokens, nxt FROM step WHERE s = 0
  UNION ALL SELECT c.video_id, c.chunk_index + 1, step.s, step.e, step.pe - step.ps, step.nxt FROM chain c JOIN n USING (video_id)
    JOIN step ON step.video_id = c.video_id AND step.s = c.nxt WHERE c.e < n.n),
chunks AS (SELECT c.video_id, any_value(o.lang) AS lang, any_value(o.track_type) AS track_type, c.chunk_index::INTEGER AS chunk_index,
  string_agg(o.text, chr(10) ORDER BY o.i) AS text, min_by(o."start", o.i) AS "start", max_by(o."end", o.i) AS "end", any_value(c.tokens)::INTEGER AS token_count
  FROM chain c JOIN ordered o ON o.video_id = c.video_id AND o.i > c.s AND o.i <= c.e GROUP BY c.video_id, c.chunk_index)"""


CHUNKS = chunks_sql(OVERLAP)
_CHUNK_COLUMNS = 'video_id, lang, track_type, chunk_index, text, "start", "end", token_count'


def chunks(spark: SparkSession, sf_dir: str, overlap: float = OVERLAP, min_tokens: int = MIN) -> DataFrame:
    return chunking.chunk_transcripts(segments(spark, sf_dir), min_tokens, MAX, overlap)


def chunks_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks, with no exchange of texts: a document is a transcript. Only rows that share their key are brought together."""
    docs = table(spark, sf_dir, "documents")
    shared = docs.groupBy("doc_id", "lang").count().filter("count > 1").select(F.col("doc_id").alias("id"), F.col("lang").alias("in"))
    alone = chunking.chunk_nested(transcripts_from_lines(docs), MIN, MAX, OVERLAP)
    if shared.isEmpty():
        return alone
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("lang").eqNullSafe(F.col("in"))
    alone = chunking.chunk_nested(transcripts_from_lines(docs.join(shared, same, "left_anti")), MIN, MAX, OVERLAP)
    return alone.unionByName(chunking.chunk_transcripts(segments_from_lines(docs.join(shared, same, "left_semi")), MIN, MAX, OVERLAP))


@query("oversize_split", f'WITH {UNITS} SELECT video_id, seg_idx, pos, "start", "end", text FROM units')
def oversize_split(spark, sf_dir):
    return chunking.units(segments(spark, sf_dir), MAX).select("video_id", "seg_idx", "pos", "start", "end", "text")


@query("chunk_transcript", f"WITH {CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks")
def chunk_transcript(spark, sf_dir):
    return chunks(spark, sf_dir)


@query("chunk_no_overlap", f"WITH {chunks_sql(0.0)} SELECT {_CHUNK_COLUMNS} FROM chunks")
def chunk_no_overlap(spark, sf_dir):
    return chunks(spark, sf_dir, 0.0)


@query("chunk_no_boundary", f"WITH {chunks_sql(0.6).replace(f'>= {MIN})', f'>= {MAX})')} SELECT {_CHUNK_COLUMNS} FROM chunks")
def chunk_no_boundary(spark, sf_dir):
    return chunks(spark, sf_dir, 0.6, MAX)


#: Tokens of the chunks, in SQL.
TOKENS = rf"""{CHUNKS}, toks AS (SELECT video_id, lang, track_type, chunk_index, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS tokens FROM chunks),
post AS (SELECT video_id, lang, track_type, chunk_index, len(tokens) AS dl, (unnest(range(len(tokens))))::INTEGER AS pos, unnest(tokens) AS term FROM toks)"""


@query("fts_tokens", r"SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS tokens FROM documents")
def fts_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.fts_tokens("text").alias("tokens"))


@query("postings", f"WITH {TOKENS} SELECT video_id, chunk_index, term, count(*) AS tf, min(pos) AS first_pos, any_value(dl)::INTEGER AS dl FROM post GROUP BY 1, 2, 3")
def postings(spark, sf_dir):
    rows = search.postings(chunks(spark, sf_dir))
    return rows.select("video_id", "chunk_index", "term", "tf", F.get("positions", F.lit(0)).alias("first_pos"), "dl")


@query("corpus_stats", f"WITH {TOKENS} SELECT count(*) AS n_chunks, sum(len(tokens))::BIGINT AS n_tokens, sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM toks")
def corpus_stats(spark, sf_dir):
    return search.corpus_stats(chunks(spark, sf_dir))


#: Every benchmark text is a query; its first two words joined by a hyphen make a phrase.
_ASKED = r"""ask AS (SELECT item_id AS query_id, split_part(text, ' ', 1) || '-' || split_part(text, ' ', 2) || ' ' || text AS q FROM benchmark),
lit AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(q, '\s+'), lambda x: replace(x, '"', '')), lambda x: regexp_matches(x, '[\p{L}\p{N}_]')) AS ws FROM ask),
uni AS (SELECT query_id, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:32] AS t FROM lit),
ph AS (SELECT query_id, (unnest(range(len(t))))::INTEGER AS phrase, regexp_extract_all(lower(strip_accents(unnest(t))), '[\p{L}\p{N}]+') AS tokens FROM uni),
want AS (SELECT query_id, phrase, len(tokens) AS width, (unnest(range(len(tokens))))::INTEGER AS nth, unnest(tokens) AS term FROM ph),
hit AS (SELECT query_id, phrase, video_id, lang, track_type, chunk_index, pos - nth AS at, any_value(dl) AS dl FROM want JOIN post USING (term)
  GROUP BY query_id, phrase, width, video_id, lang, track_type, chunk_index, pos - nth HAVING count(*) = width),
mat AS (SELECT query_id, phrase, video_id, lang, track_type, chunk_index, any_value(dl) AS dl, count(*) AS f FROM hit GROUP BY ALL)"""
_SCORED = """st AS (SELECT count(*) AS nc, sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM toks),
df AS (SELECT query_id, phrase, count(*) AS n FROM mat GROUP BY 1, 2),
part AS (SELECT mat.*, CASE WHEN ln((nc - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) > 0 THEN ln((nc - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END
  * (f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS part FROM mat JOIN df USING (query_id, phrase) CROSS JOIN st),
sc AS (SELECT query_id, video_id, lang, track_type, chunk_index, -list_sum(list(part ORDER BY phrase)) AS score FROM part GROUP BY ALL)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    pair = F.concat_ws("-", F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(pair, F.lit(" "), "text").alias("text"))


@query("phrase_match", f"WITH {TOKENS}, {_ASKED} SELECT query_id, phrase, count(*) AS n_chunks, sum(f)::BIGINT AS n_places FROM mat GROUP BY 1, 2")
def phrase_match(spark, sf_dir):
    found = search.phrase_matches(search.phrases(asked(spark, sf_dir)), search.postings(chunks(spark, sf_dir)))
    return found.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("f").alias("n_places"))


_TOP = """rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), video_id, lang, track_type, chunk_index) AS rank FROM sc {where})
SELECT query_id, rank::INTEGER AS rank, rk.video_id, rk.chunk_index, round(score, 9) AS score, c."start", c."end",
  'https://www.youtube.com/watch?v=' || rk.video_id || '&t=' || trunc(c."start")::BIGINT::VARCHAR || 's' AS url
FROM rk JOIN chunks c ON c.video_id = rk.video_id AND c.chunk_index = rk.chunk_index WHERE rank <= 5"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "video_id", "chunk_index", F.round("score", 9).alias("score"), "start", "end", "url")


@query("bm25_topk", f"WITH {TOKENS}, {_ASKED}, {_SCORED}, {_TOP.format(where='')}")
def bm25_topk(spark, sf_dir):
    return _shown(search.search(chunks_in_place(spark, sf_dir), asked(spark, sf_dir)))


@query("bm25_topk_by_video", f"WITH {TOKENS}, {_ASKED}, {_SCORED}, {_TOP.format(where='WHERE (video_id::BIGINT - query_id) % 40 = 0')}")
def bm25_topk_by_video(spark, sf_dir):
    own = (F.col("video_id").cast("bigint") - F.col("query_id")) % 40 == 0
    return _shown(search.search(chunks_in_place(spark, sf_dir), asked(spark, sf_dir), within=own))


#: Transcripts of languages other than German have been indexed.
_INDEXED = f"{CHUNKS}, idx AS (SELECT * FROM chunks WHERE lang <> 'de')"


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).filter("lang <> 'de'")


def indexed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the indexed transcripts: those that are not blank have chunks."""
    return normalised(segments(spark, sf_dir)).filter("lang <> 'de'")


@query("index_present", f"WITH {_INDEXED} SELECT DISTINCT video_id, lang, track_type FROM seg WHERE video_id IN (SELECT video_id FROM idx)")
def index_present(spark, sf_dir):
    return search.is_indexed(segments(spark, sf_dir), indexed_keys(spark, sf_dir))


@query("index_missing", f"WITH {_INDEXED} SELECT DISTINCT video_id, lang, track_type FROM seg WHERE video_id NOT IN (SELECT video_id FROM idx)")
def index_missing(spark, sf_dir):
    return search.missing(segments(spark, sf_dir), indexed_keys(spark, sf_dir))


@query(
    "index_replace",
    f"WITH {_INDEXED} SELECT video_id, chunk_index, CASE WHEN lang IN ('de', 'fr') THEN 'new: ' || text ELSE text END AS text FROM chunks",
)
def index_replace(spark, sf_dir):
    new = chunks(spark, sf_dir).filter(F.col("lang").isin("de", "fr")).withColumn("text", F.concat(F.lit("new: "), "text"))
    return store.replace_keys(indexed(spark, sf_dir), new).select("video_id", "chunk_index", "text")


@query("index_delete", f"WITH {CHUNKS} SELECT video_id, chunk_index, token_count FROM chunks WHERE NOT (lang = 'fr' AND track_type = 'manual')")
def index_delete(spark, sf_dir):
    return store.delete_matching(chunks(spark, sf_dir), lang="fr", track_type="manual", video_id=None).select("video_id", "chunk_index", "token_count")
