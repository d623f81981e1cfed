"""Text expressions. Regular expressions are Unicode-aware: (?U), and strip() is not trim()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank, in the sense that Python's str.strip and str.split have.
BLANK = r"[\s\x1c-\x1f]"
#: All blanks.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNICODE = "(?U)"

# Stop words, Spanish and English.
STOP_WORDS_ES = (
    "el la los las un una unos unas de del en y o u que qué se su sus "
    "por para con sin sobre entre hasta desde esto esta este estos estas "
    "ese esa esos esas aquel aquello ello lo le les me te nos os mi mis "
    "tu tus es son fue fueron era eran hay está están estoy estamos "
    "tiene tienen tengo tenemos hace hacen hizo muy más mas menos pero "
    "como cómo cuando donde dónde cual cuál cuales porque pues así tan "
    "solo sólo también tampoco algo nada todo todos todas cada cual "
    "quien quienes cuyo cuya aquí ahí allí entonces bueno pues mira "
    "mirad oye vale bueno"
).split()
STOP_WORDS_EN = (
    "the a an of in on and or but to for with without from by at as is "
    "are was were be been being it its this that these those he she "
    "they them his her their we you your our i me my we us have has "
    "had do does did will would can could should there here what which "
    "who whom whose when where why how not no yes so very more most "
    "some any all each"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS_ES + STOP_WORDS_EN))

CHARS_PER_TOKEN = 4
MOST_QUERY_TERMS = 32


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without blanks at both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def collapse(c: str | Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.regexp_replace(strip(c), rf"{UNICODE}{BLANK}+", " ")


def clean_caption(c: str | Column) -> Column:
    """Caption text without markup: tags become blanks, blanks collapse."""
    return collapse(F.regexp_replace(col(c), "<[^>]+>", " "))


def est_tokens(c: str | Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(col(c)) / CHARS_PER_TOKEN)


def ends_sentence(c: str | Column) -> Column:
    """Whether the text closes a sentence, quotes and brackets aside."""
    return F.right(F.rtrim(strip(c), F.lit("\"'»”)]")), F.lit(1)).isin(*".!?…")


def split_sentences(c: str | Column) -> Column:
    """Sentences, cut at blanks behind a terminator; terminators stay; no empty ones."""
    return F.filter(F.split(col(c), rf"{UNICODE}(?<=[.!?…]){BLANK}+"), lambda s: s != "")


def terms(c: str | Column) -> Column:
    """Words in lower case, without stop words and single characters."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(rf"{UNICODE}\w+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))


def query_terms(c: str | Column, most: int = MOST_QUERY_TERMS) -> Column:
    """Literals of a search text: split at blanks, without quotes, distinct in order, at most `most`."""
    words = F.transform(F.split(col(c), rf"{UNICODE}{BLANK}+"), lambda w: F.replace(w, F.lit('"')))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.regexp_like(w, F.lit(rf"{UNICODE}\w")))), 1, most)


def match_query(c: str | Column) -> Column:
    """The literals quoted and joined by OR; null if there are none."""
    quoted = F.array_join(F.transform(query_terms(c), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")
    return F.nullif(quoted, F.lit(""))


def sanitise_query(query: str, most: int = MOST_QUERY_TERMS) -> list[str]:
    """query_terms for a literal in the driver; an error if there are none."""
    found: dict[str, None] = {}
    for word in query.split():
        word = word.replace('"', "")
        if any(ch.isalnum() or ch == "_" for ch in word):
            found[word] = None
    if not found:
        raise ValueError("the query holds no searchable term")
    return list(found)[:most]


def lang_key(c: str | Column) -> Column:
    """Requested languages as one key."""
    return F.array_join(col(c), "+")


def job_id(video: str | Column, key: str | Column) -> Column:
    return F.concat_ws(":", col(video), col(key))


def iso(c: str | Column) -> Column:
    """A timestamp as UTC text of fixed width, so that text order is time order; whatever the session's zone is."""
    return F.concat(F.date_format(F.to_utc_timestamp(col(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def parse_iso(c: str | Column) -> Column:
    return F.to_timestamp(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def client_status(c: str | Column) -> Column:
    """Job states as clients see them."""
    s = col(c)
    return F.when(s.isin("pending", "processing"), "processing").when(s == "completed", "completed").otherwise("error")


def or_default(c: str | Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))
