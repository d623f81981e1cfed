from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.functions import locators, text

ID = "Qx7-tb_0Zk9"

#: Addresses with an id, by rule.
FORMS = ["www.youtube.com/watch?v={}", "www.youtube.com/embed/{}", "www.youtube.com/shorts/{}", "youtu.be/{}"]
HOSTS = ["youtube.com", "m.youtube.com", "www.youtube.com"]
VALID = [f"https://{f.format(ID)}" for f in FORMS] + [f"http://{h}/watch?v={ID}" for h in HOSTS]
VALID += [f"https://youtu.be/{ID}?si=tracker", f"https://youtube.com/watch?feature=share&v={ID}&t=3#top", f"\t https://youtu.be/{ID}\n", f"https://www.youtu.be/{ID}"]
VALID += [f"HttpS://M.YOUTUBE.com:8443/watch?v={ID}", f"https://youtube.com/watch?list=&v={ID}"]
#: Those without, by the rule that they break.
INVALID = {
    "empty": [None, "", " \t\n"],
    "scheme": [ID, "youtu.be", f"file:///watch?v={ID}", f"ws://youtu.be/{ID}"],
    "host": [f"https://youtube.com.example.org/watch?v={ID}", f"https://vimeo.example/{ID}", "http://[fe80::/x"],
    "playlist": [f"https://youtube.com/watch?list=ABC&v={ID}", "https://m.youtube.com/playlist?list=ABC"],
    "live": [f"https://youtube.com/live/{ID}?feature=share"],
    "bad_id": ["https://youtu.be", f"https://youtu.be/{ID}0", f"https://youtube.com/watch?v={ID[:-1]}", f"https://youtube.com/embed/{ID[:-1]}%"],
    "unrecognised": ["https://youtube.com/channel/some", "https://www.youtube.com/"],
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids(spark, frame):
    rows = frame([(u,) for u in VALID], "url string").select("url", locators.analyse("url").alias("a")).collect()
    assert {r["url"]: tuple(r["a"]) for r in rows} == {u: (ID, None) for u in VALID}


def test_reasons(spark, frame):
    expected = {u: (None, reason) for reason, urls in INVALID.items() for u in urls}
    rows = frame([(u,) for u in expected], "url string").select("url", locators.analyse("url").alias("a")).collect()
    assert {r["url"]: tuple(r["a"]) for r in rows} == expected


def test_valid_id(spark, frame):
    cases = {ID: True, "-" * 11: True, "_" * 10: False, ID + "\n": False, "ñ" * 11: False, "a b c d e f": False, "": False, None: False}
    rows = frame([(c,) for c in cases], "c string").select("c", locators.is_valid_id("c").alias("v")).collect()
    assert {r["c"]: r["v"] for r in rows} == cases


def test_citation_cuts_fractions(spark):
    assert one(spark, locators.citation(F.lit(ID), F.lit(620.9))) == f"https://www.youtube.com/watch?v={ID}&t=620s"


@pytest.mark.parametrize("s,n", [("abcd" * 10, 10), ("abcde", 2), ("", 0)])
def test_est_tokens(spark, s, n):
    assert one(spark, text.est_tokens(F.lit(s))) == n


@pytest.mark.parametrize("s,ends", [("Fin.", True), ('Fin."  ', True), ("Fin…»)", True), ("Fin", False), ("", False), ("a.b", False)])
def test_ends_sentence(spark, s, ends):
    assert one(spark, text.ends_sentence(F.lit(s))) is ends


def test_unicode(spark):
    blank = "  niño x 　"
    assert one(spark, text.strip(F.lit(blank))) == "niño x"
    assert one(spark, text.terms(F.lit("El niño y THE añO a ñ"))) == ["niño", "año"]
    assert one(spark, text.split_sentences(F.lit("Uno. Dos! ¿Tres?  Cuatro… cinco"))) == ["Uno.", "Dos!", "¿Tres?", "Cuatro…", "cinco"]
    assert one(spark, text.clean_caption(F.lit("<c.a>Hola</c>\n<i>mundo</i> "))) == "Hola mundo"


def test_match_query(spark):
    query = 'foo OR "bar" NEAR/x *'
    assert one(spark, text.match_query(F.lit(query))) == '"foo" OR "OR" OR "bar" OR "NEAR/x"'
    assert text.sanitise_query(query) == ["foo", "OR", "bar", "NEAR/x"]
    many = " ".join(f"t{i}" for i in range(50))
    assert one(spark, text.match_query(F.lit(many))).count(" OR ") == 31
    assert one(spark, text.match_query(F.lit("* !"))) is None
    with pytest.raises(ValueError):
        text.sanitise_query(' " * ')


def test_stop_words():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 185


def test_keys_and_defaults(spark):
    assert one(spark, text.job_id(F.lit("v"), text.lang_key(F.array(F.lit("es"), F.lit("en"))))) == "v:es+en"
    assert one(spark, text.or_default(F.lit(""), "d")) == "d"
    assert [one(spark, text.client_status(F.lit(s))) for s in ("pending", "processing", "completed", "failed", "odd")] == ["processing", "processing", "completed", "error", "error"]
    stamp = F.timestamp_micros(F.lit(1_700_000_000_000_000))
    assert one(spark, text.iso(stamp)) == "2023-11-14T22:13:20.000000+00:00"
    assert one(spark, F.unix_micros(text.parse_iso(text.iso(stamp)))) == 1_700_000_000_000_000
