"""Text, matching, mail body and date functions against fixed examples."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import mailbody as B
from folioframe.functions import matching as M
from folioframe.functions import text as T
from folioframe.operators import retrieval as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("AW: Re: FW: Roof  Repair (Forwarded)", "roof repair"), ("Re[2]: a   B", "a b"), (None, ""), ("Reply needed", "reply needed")])
def test_subject(spark, raw, want):
    assert one(spark, T.normalize_subject(F.lit(raw).cast("string"))) == want


def test_terms_and_query(spark):
    assert one(spark, T.fts_query(F.lit("When did they approve our garden budget, and the budget 2025?"))) == '"garden" OR "budget" OR "2025"'
    assert one(spark, T.query_terms(F.lit("of the and"))) == []


def test_ids(spark):
    assert one(spark, T.clean_id(F.lit("x <a@b> <c@d>"))) == "<a@b>"
    assert one(spark, T.clean_id(F.lit("none"))) is None
    assert one(spark, T.reference_ids(F.lit("<a@b> <c@d>"))) == ["<a@b>", "<c@d>"]
    assert one(spark, T.thread_id(F.lit("<1@x>"))).startswith("T-") and len(one(spark, T.thread_id(F.lit("<1@x>")))) == 12
    assert one(spark, T.name_from_address(F.lit("ann_b.c-d@x.org"))) == "Ann B C D"


def test_redaction_keeps_keys_and_short_numbers(spark):
    df = spark.createDataFrame([("<k1@host.example>", "ask kim.o@office.example or 030 555 12 34 56, pay 2,500 to DE89370400440532013000")], "thread_id string, note string")
    row = T.redact(df).first()
    assert row["thread_id"] == "<k1@host.example>"
    assert row["note"] == "ask [email] or [phone], pay 2,500 to [IBAN]"


def test_citations_enforced(spark):
    md = "The roof is tiled in May [^4]. Nobody minds. Paint comes later [^7].\nThe yard waits [^9]."
    got = one(spark, T.enforce_citations(F.lit(md), F.array(F.lit(4), F.lit(9)), F.lit("found")))
    assert got["text"] == "The roof is tiled in May [^4].\nThe yard waits [^9]." and got["dropped"] == 2
    lead = "There is no recorded decision on paint. Kim wants green [^2]."
    assert one(spark, T.enforce_citations(F.lit(lead), F.array(F.lit(2)), F.lit("found")))["text"] == lead
    assert one(spark, T.enforce_citations(F.lit("It is disputed. So it is."), F.array().cast("array<int>"), F.lit("contested")))["text"] == "It is disputed."


def test_dates(spark):
    import datetime as dt

    when = T.rfc2822_time(F.lit("Thu, 4 Jun 2026 18:30:05 +0530"))
    assert one(spark, when) == dt.datetime(2026, 6, 4, 13, 0, 5)
    assert one(spark, T.rfc2822_time(F.lit("nonsense"))) == dt.datetime(1970, 1, 1)
    assert one(spark, T.local_time(when, F.lit("+0530"))) == dt.datetime(2026, 6, 4, 18, 30, 5)
    assert [one(spark, T.valid_date(F.lit(x))) for x in ("2026-06-04", "2026-06-31", "4 June")] == [True, False, False]


TEXT = "Fine by me – “green” paint  for the\tshed, and no later than Friday’s market."


def test_spans_are_of_the_source():
    assert M.find_exact('FINE by me - "green" paint', TEXT) == "Fine by me – “green” paint"
    assert M.find_exact("paint for the shed", TEXT) == "paint  for the\tshed"
    assert M.find_exact("a", TEXT) is None and M.find_exact("abc", "") is None
    hit = M.find_fuzzy("no later than Fridays market", TEXT)
    assert hit == "no later than Friday’s market"
    assert M.find_fuzzy("the fence will be blue after all", TEXT) is None and M.find_fuzzy("short", TEXT) is None


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_common_length(a, b):
    assert M.common_length(a, b) == _lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_normalized_map(text):
    folded, places = M.normalize_with_map(text)
    assert len(folded) == len(places) and places == sorted(places)
    assert not folded.startswith(" ") and not folded.endswith(" ") and "  " not in folded


def test_names():
    assert M.similar_names("Zoë Brønn", "zoe brønn") and M.similar_names("Kim van Oord", "Kim Oord")
    assert not M.similar_names("Kim", "Kem") and not M.similar_names("", "")


def test_body_parts():
    p = B.split_body("Green it is.\n\nBest regards\nKim Oord\nGardens Ltd\n\nAm 3. Mai 2026 schrieb Zoe <z@y.example>\nin Eile schrieb:\n> blue or green?", "Kim Oord", "kim@y.example")
    assert p["new"].startswith("Green it is.") and p["fwd"] == "" and p["meta"] is None
    p = B.split_body("Inline below.\n> blue or green?\ngreen\n\nOn Sunday afternoon Zoe Brand\nwrote:\n> hello", "Kim Oord", "kim@y.example")
    assert p["new"] == "Inline below.\ngreen" and "> blue or green?" in p["quoted"] and "> hello" in p["quoted"]
    p = B.split_body("Yes.\n\nVon: Zoe <z@y.example>\nGesendet: gestern\nBetreff: Farbe\n\nWelche?", "Kim Oord", "kim@y.example")
    assert p["new"] == "Yes." and "Welche?" in p["quoted"]
    block = ["see this", "", "Begin forwarded message:", "", "From: Zoe Brand <Z@y.example>", "Date: Sun, 3 May 2026 20:15:00 +0200", "Subject: paint", "To: kim@y.example", "", "the shop closes at noon", "", "On Friday, the third, Lee wrote:", "> when?"]
    p = B.split_body("\n".join(block), "Kim Oord", "kim@y.example")
    assert p["new"] == "see this" and p["fwd"] == "the shop closes at noon" and "> when?" in p["quoted"]
    assert p["meta"] == {"from_name": "Zoe Brand", "from_addr": "z@y.example", "date_raw": "Sun, 3 May 2026 20:15:00 +0200", "date": "2026-05-03T18:15:00+00:00", "subject": "paint"}
    assert B.split_body("", "", "") == {"new": "", "quoted": "", "fwd": "", "meta": None}


@pytest.mark.parametrize("last", ["Thanks, paint it.", "sunday at noon", "do it", "Kim speaking, go ahead."])
def test_content_is_no_signature(last):
    assert B.strip_signature(["We talked.", "", last], "Kim Oord", "kim@y.example")[-1] == last


@pytest.mark.parametrize("tail", [["Cheers", "Kim"], ["— Kim"], ["Saludos!", "", "Kim Oord", "Gardens Ltd"], ["--", "anything", "at all"], ["Sent from my phone", "", "K"], ["Thanks again,", "", "Regards", "Kim Oord"], ["DISCLAIMER: for your eyes only"]])
def test_signatures_go(tail):
    assert B.strip_signature(["The gate is fixed.", "", *tail], "Kim Oord", "kim@y.example") == ["The gate is fixed."]


def test_html():
    text = B.html_to_text("<head><title>t</title></head><div>Gate<br>and fence</div><style>p{}</style><ul><li>nails</li><li>glue</li></ul><blockquote>first<br>second</blockquote>bye")
    assert "Gate\nand fence" in text and "p{}" not in text and "- glue" in text and "> first\n> second" in text and text.endswith("bye")
    assert B.html_to_text(None) == ""


def test_passages():
    text = "\n\n".join(["one two three. " * 30, "A short one.", "tail " * 45])
    got = V.split_passages(text, 50)
    assert all(len(p.split()) <= 50 for p in got) and " ".join(got).split() == text.split()
    assert V.split_passages("", 5) == [] and V.split_passages("a " * 9, 5) == [("a " * 9).strip()]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("zzz",), ("",)], "t string").select(V.hash_embedding("t").alias("v"))
    v = [r["v"] for r in df.collect()]
    assert v[0] == v[1] != v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and not any(v[3])
    assert isinstance(pd.Series(v[0]).iloc[0], float)


def test_words_and_grams_are_hashed_once_a_worker(monkeypatch):
    hashed: list = []
    real = V.hashlib.blake2b
    monkeypatch.setattr(V.hashlib, "blake2b", lambda raw, **k: hashed.append(raw) or real(raw, **k))
    first = V.embed_texts(["gate fence gate", "fence"])
    hashed.clear()
    assert (V.embed_texts(["gate fence gate", "fence"]) == first).all() and sorted(hashed) == [b"fence_gate", b"gate_fence"]
    monkeypatch.setattr(V, "KNOWN", 3)
    assert (V.embed_texts(["gate fence gate", "fence"]) == first).all() and not V.embed_texts(["", None]).any() and V.embed_texts([]).shape == (0, V.DIM)
