"""Threads, identity, verification, ledger, retrieval, clusters and sources on small tables."""

import datetime as dt
import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import cluster as C
from folioframe.operators import identity as I
from folioframe.operators import ledger as L
from folioframe.operators import metrics as X
from folioframe.operators import relational as R
from folioframe.operators import retrieval as V
from folioframe.operators import serving as S
from folioframe.operators import threads as TH
from folioframe.operators.graph import components, reachable
from folioframe.operators.verify import quote_stats, verify_quotes
from folioframe.plans.scratch import Scratch
from folioframe.schemas import ANSWERS, DDL
from folioframe.sources import mailbox, tables
from folioframe.streaming import ingest


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


def eml(body="hi", **headers):
    head = {"From": "Ann Lee <ann@x.example>", "To": "bob@x.example", "Subject": "Shed", "Date": "Mon, 05 Jan 2026 10:00:00 +0100", "Message-ID": "<1@x>"} | {k.replace("_", "-"): v for k, v in headers.items()}
    return ("\r\n".join(f"{k}: {v}" for k, v in head.items() if v) + "\r\n\r\n" + body).encode()


@pytest.fixture(scope="module")
def mails(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    (root / "a.eml").write_bytes(eml("The shed costs 900 in all.\n\nKind regards\nAnn Lee\nHead gardener, Gardens Ltd"))
    (root / "b.eml").write_bytes(eml("a", From="Bob Ray <bob@x.example>", To="ann@x.example", Subject="=?utf-8?q?Re=3A_Shed?=", Message_ID="<2@x>", In_Reply_To="<1@x>"))
    (root / "skip.txt").write_bytes(b"no")
    with zipfile.ZipFile(root / "c.zip", "w") as z:
        z.writestr("1.eml", eml("b", Subject="Shed (fwd)", Message_ID="<3@x>", Date="Tue, 06 Jan 2026 10:00:00 +0100"))
        z.writestr("2.eml", eml("again", Message_ID="<1@x>"))
    box = b"".join(b"From x Mon Jan  5 10:00:00 2026\n" + eml("c", From="Zed <zed@y.example>", To="q@y.example", Message_ID="<4@x>", Date="bad").replace(b"\r\n", b"\n") + b"\n\n" for _ in range(1))
    (root / "d.mbox").write_bytes(box + b"From y Mon Jan  5 10:00:00 2026\n" + eml("no id", Message_ID="").replace(b"\r\n", b"\n") + b"\n")
    return mailbox.load_emails(spark, str(root)).cache()


def test_mail_scan(mails):
    rows = {r["message_id"]: r for r in mails.collect()}
    assert len(rows) == 5 and rows["<2@x>"]["subject"] == "Re: Shed" and rows["<2@x>"]["in_reply_to"] == "<1@x>"
    assert rows["<1@x>"]["new_text"] == "The shed costs 900 in all." and rows["<1@x>"]["sent_tz"] == "+0100"
    assert rows["<1@x>"]["sent_at"] == dt.datetime(2026, 1, 5, 9) and rows["<4@x>"]["sent_at"] == dt.datetime(1970, 1, 1)
    assert any(k.startswith("<generated-") for k in rows)


def test_threads(spark, scratch, mails):
    mapping, threads = TH.build_threads(scratch, mails)
    of = {r["message_id"]: r["thread_id"] for r in mapping.collect()}
    assert of["<1@x>"] == of["<2@x>"] == of["<3@x>"] != of["<4@x>"]
    assert sum(r["n_msgs"] for r in threads.collect()) == 5
    told = TH.positions(mails.join(mapping, "message_id"))
    first = told.where("message_id = '<2@x>'").first()
    assert first["parent_in_thread"] and first["alias"].startswith("m")
    assert "[m1]" in TH.render(mails.join(mapping, "message_id")).where(F.col("thread_id") == of["<1@x>"]).first()["text"]
    assert TH.related_threads(threads).columns == ["thread_id", "other_id", "rank"]


def test_identity(spark, scratch):
    rows = [("<1>", "ann@x.org", "Ann Lee", dt.datetime(2026, 1, 1), "hi\n\nAnn Lee\nHead of Sales, Nimbus"), ("<2>", "a.lee@x.org", "Ann  Lee", dt.datetime(2026, 1, 2), "x"), ("<3>", "ann@home.net", "Ann Lee", dt.datetime(2026, 1, 3), "x"), ("<4>", "bob@x.org", "", dt.datetime(2026, 1, 4), "x")]
    e = spark.createDataFrame(rows, "message_id string, from_addr string, from_name string, sent_at timestamp, body_raw string")
    e = e.withColumn("to_named", F.expr("array(named_struct('name', 'Bob Ray', 'addr', 'bob@x.org'))")).withColumn("to_addrs", F.array(F.lit("bob@x.org"))).withColumn("cc_addrs", F.array().cast("array<string>")).withColumn("new_text", F.lit("hello bob"))
    people, idents = I.resolve(scratch, e)
    names = {r["canonical_name"]: r for r in people.collect()}
    assert set(names) == {"Ann Lee", "Bob Ray"} or set(names) == {"Ann  Lee", "Bob Ray"}
    assert all(r["is_internal"] for r in names.values())
    assert idents.where("kind = 'email'").count() == 4
    told = {r["canonical_name"]: r["role_guess"] for r in I.roles(e, people, idents).collect()}
    assert "Head of Sales" in told.values()
    assert I.received_sample(e, people, idents, 1).where("kind = 'received'").count() >= 1


def test_verify(spark):
    texts = spark.createDataFrame([("t", "<a>", 1, "some other words", ""), ("t", "<b>", 2, "Tell  Ann before the nails are bought. We paint it green from 6 July.", ""), ("t", "<f>", 3, "FYI", "the shop shuts at noon on sundays.")], "thread_id string, message_id string, pos int, new_text string, fwd_text string")
    quotes = spark.createDataFrame([(1, "t", "<a>", "Tell Ann before the nails"), (2, "t", "<b>", "the fence will be blue after all"), (3, "t", "<f>", "the shop shuts at Noon"), (4, "t", "<b>", "We paint it green from 6 Jully.")], "quote_id int, thread_id string, message_id string, quote string").withColumn("role", F.lit("decision"))
    got = verify_quotes(quotes, texts).cache()
    assert {r["quote_id"]: (r["source_id"], r["how"]) for r in got.collect()} == {1: ("<b>", "reanchored"), 2: ("<b>", "dropped"), 3: ("<f>", "exact"), 4: ("<b>", "snapped")}
    stats = quote_stats(got).first()
    assert (stats["quotes_total"], stats["quotes_snapped"], stats["quotes_dropped"]) == (4, 2, 1)


def test_ledger(spark):
    answer = {"records": [{"topic_label": "pay", "decision_text": "go", "stance": "final", "decision_type": "explicit", "decided_by": ["Ann"], "decision_date": "soon", "evidence": [{"message_id": "[m2]", "quote": "we paint it green", "role": "approval"}]}, {"topic_label": "x", "decision_text": "y", "stance": "final", "evidence": [{"message_id": "m1", "quote": "never said at all here", "role": "recap"}]}]}
    import json

    req = spark.createDataFrame([("T-1234567890", json.dumps({"thread": 1}))], "thread_id string, request string")
    cache = spark.createDataFrame([(tables.request_key({"thread": 1}), "```json\n" + json.dumps(answer) + "\n```")], DDL["llm_cache"])
    got, missing = tables.answers(req, cache, "extract")
    assert got.count() == 1 and missing.count() == 0
    msgs = spark.createDataFrame([("T-1234567890", "<1>", "m1", 1, dt.datetime(2026, 1, 5, 23, 30), "+0100", "hello", ""), ("T-1234567890", "<2>", "m2", 2, dt.datetime(2026, 1, 6, 23, 30), "+0100", "ok. We paint it green", "")], "thread_id string, message_id string, alias string, pos int, sent_at timestamp, sent_tz string, new_text string, fwd_text string")
    recs, ev = L.records(got.select("thread_id", "answer"), msgs)
    row = recs.first()
    assert recs.count() == 1 and row["record_id"] == "R-1234567890-01" and row["decision_date"] == "2026-01-07"
    assert ev.first()["quote"] == "We paint it green"
    direct = L.direct_decisions(recs.withColumn("cluster_id", F.lit("C-1")), ev)
    assert direct.count() == 1
    drafts = spark.createDataFrame([("C-1", "d10", "2026-01-02", "active"), ("C-1", "d2", "2026-01-02", "active"), ("C-0", "d1", "2026-01-01", "contested")], "cluster_id string, temp_id string, decided_at string, status string")
    edges = spark.createDataFrame([("C-1", "d2", "d10", "supersedes"), ("C-1", "d2", "gone", "amends")], "cluster_id string, src string, dst string, kind string").selectExpr("*", "'' scope", "'' aspect", "'' rationale")
    con = spark.createDataFrame([("k1", "C-0", "t", "s")], "conflict_id string, cluster_id string, topic string, summary string")
    sides = spark.createDataFrame([("k1", "p", "Ann"), ("k1", "q", "Bob")], "conflict_id string, side string, claimant string")
    dec, linked, con, sides = L.number_ledger(drafts, edges, con, sides)
    assert {r["decision_id"]: r["status"] for r in dec.collect()} == {"DEC-0001": "contested", "DEC-0002": "superseded", "DEC-0003": "active"}
    assert linked.count() == 1 and con.first()["conflict_id"] == "CON-001" and {r["side"] for r in sides.collect()} == {"A", "B"}
    flags = L.triage(spark.createDataFrame([("t1",), ("t2",), ("t3",)], "thread_id string"), spark.createDataFrame([("t1", (False, [("m1", "approval", "")])), ("t2", (False, [("m1", "chatter", "")]))], f"thread_id string, answer struct<{ANSWERS['triage'].replace('has_candidate boolean', 'has_candidate:boolean').replace(', messages ', ',messages:')}>"), msgs.select("thread_id", "alias", "message_id"))[1]
    assert {r["thread_id"]: r["has_candidate"] for r in flags.collect()} == {"t1": True, "t2": False, "t3": True}


def test_confidence(spark):
    rows = [("found", 0, 2, 2, 0, True, "high"), ("found", 0, 1, 1, 0, True, "medium"), ("found", 1, 2, 2, 0, True, "low"), ("partial", 0, 2, 2, 0, True, "low"), ("no_decision", 0, 0, 0, 1, None, "medium"), ("no_decision", 0, 0, 0, 0, None, "low"), ("found", 0, 2, 2, 0, False, "medium")]
    df = spark.createDataFrame(rows, "s string, e int, c int, m int, k int, x boolean, want string")
    assert df.where(R.answer_confidence(F.col("s"), F.col("e"), F.col("c"), F.col("m"), F.col("k"), F.col("x")) != F.col("want")).count() == 0


def test_graph(spark, scratch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 8), (8, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(scratch, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4}
    got = reachable(scratch, spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string"))
    assert {r["node"] for r in got.collect()} == {"a", "b", "c"}
    assert components(scratch, edges.limit(0)).count() == 0


def test_retrieval(spark):
    ranks = [spark.createDataFrame(list(zip(x, range(1, 9))), "id string, rank int") for x in (["a", "b"], ["b", "c"])]
    assert [r["id"] for r in V.rrf(ranks, "id").collect()][0] == "b"
    docs = spark.createDataFrame([(1, "oak shed oak"), (2, "no such"), (3, "shed list of things")], "id long, text string")
    got = V.bm25(docs, "id", F.col("text"), ["oak", "shed"], 5).collect()
    assert [r["id"] for r in got] == [1, 3]
    rows, fresh = V.embed(docs, spark.createDataFrame([], DDL["embed_cache"]))
    assert rows.count() == 3 and fresh.count() == 3
    a = spark.createDataFrame([("q", "Paint on 6 July [^1][^2].", [(1, "<1>", "paint on 6 july")], ["DEC-1"])], "answer_id string, answer_md string, citations array<struct<n:int,message_id:string,quote:string>>, decision_ids array<string>")
    t = spark.createDataFrame([("<1>", "We paint on 6 July.", "")], "message_id string, new_text string, fwd_text string")
    row = V.check_answer(a, t, spark.createDataFrame([], "decision_id string")).first()
    assert row["cites"][0]["quote"] == "paint on 6 July" and row["errors"] == ["marker [^2] has no citation", "unknown decision id DEC-1"]


def test_assignment():
    rng = np.random.default_rng(0)
    for n, m in itertools.product((1, 2, 3, 4), repeat=2):
        w = np.round(rng.random((n, m)) * (rng.random((n, m)) > 0.3), 2)
        got = C.assign(w)
        small, big = min(n, m), max(n, m)
        t = w if n <= m else w.T
        best = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert abs(sum(w[p] for p in got) - best) < 1e-9 and len({a for a, _ in got}) == len(got) == len({b for _, b in got})


def test_clusters(spark, scratch):
    sim = np.array([[1, 0.9, 0.1, 0.7], [0.9, 1, 0.2, 0.5], [0.1, 0.2, 1, 0.95], [0.7, 0.5, 0.95, 1]])
    link = np.ones((4, 4), bool)
    link[2, 3] = link[3, 2] = False
    assert C.agglomerate(sim, link, 0.55) == [[0, 1, 3], [2]]
    recs = spark.createDataFrame([("r1", [1.0, 0.0], ["p"], ["e1"], "a", "2026-01-02"), ("r2", [0.9, 0.1], ["p"], ["e1"], "b", "2026-01-01"), ("r3", [0.0, 1.0], ["q"], ["e9"], "c", "2026-01-03")], "record_id string, vec array<double>, people array<string>, entities array<string>, topic_label string, decision_date string")
    got = C.cluster_records(scratch, recs)
    assert {r["record_id"]: r["root"] for r in got.collect()} == {"r1": "r1", "r2": "r1", "r3": "r3"}
    told, clusters = C.name_clusters(got, recs)
    assert sorted((r["n_records"], r["topic"]) for r in clusters.collect()) == [(1, "c"), (2, "b")]


def test_metrics_and_serving(spark, scratch, tmp_path):
    dec = spark.createDataFrame([("DEC-1", "C", "Use oak", "2026-01-01", "cheap", "explicit", "superseded"), ("DEC-2", "C", "Use pine", "2026-02-01", None, "explicit", "active"), ("DEC-3", "D", "Hire", "2026-03-01", "x", "implicit", "contested")], "decision_id string, cluster_id string, canonical_text string, decided_at string, rationale string, decision_type string, status string")
    edges = spark.createDataFrame([("DEC-2", "DEC-1", "supersedes")], "src string, dst string, kind string")
    assert [r["decision_id"] for r in S.list_decisions(dec, q="pine").collect()] == ["DEC-2"]
    assert [r["decision_id"] for r in S.list_decisions(dec, status="active,contested", since="2026-02-15").collect()] == ["DEC-3"]
    emails = spark.createDataFrame([("<1>", "T", "s", "ann@x", "Ann", dt.datetime(2026, 1, 1), "we use oak", "older words", ("Old Author", "old@x", "2025-12-01", None, None))], f"message_id string, thread_id string, subject string, from_addr string, from_name string, sent_at timestamp, new_text string, fwd_text string, fwd_meta {DDL['emails'].split('fwd_meta ')[1].split('>')[0]}>")
    ev = spark.createDataFrame([(1, "decision", "DEC-1", "<1>", "use oak", "decision", True), (2, "decision", "DEC-1", "<1>", "older words", "recap", True), (3, "decision", "DEC-2", "<1>", "not there", "recap", False)], DDL["evidence"])
    page = S.decision_page(scratch, "DEC-2", dec, edges, ev, emails)
    assert page["chain"].count() == 2 and page["edges"].count() == 1 and page["evidence"].count() == 0
    cards = {r["id"]: r for r in S.evidence_cards(ev, emails).collect()}
    assert cards[2]["forwarded"] and cards[2]["author"] == "Old Author" and cards[1]["author"] == "Ann"
    assert S.decision_page(scratch, "none", dec, edges, ev, emails)["decision"].count() == 0
    assert X.quote_validity(ev, emails).first()["validity"] == 1.0
    con = spark.createDataFrame([("CON-001", "D", "t", "s")], DDL["conflicts"])
    sides = spark.createDataFrame([("CON-001", "A", "Ann", "x")], DDL["conflict_sides"])
    assert S.conflict_list(con, sides, ev, dec).first()["decision_id"] == "DEC-3"
    fb = S.dispute(spark.createDataFrame([], DDL["feedback"]), "DEC-1", "n" * 3000)
    assert len(fb.first()["note"]) == 2000
    truth = spark.createDataFrame([("g2", "g1", "supersedes")], "src string, dst string, kind string")
    m = spark.createDataFrame([("g1", "DEC-1"), ("g2", "DEC-2")], "truth_id string, decision_id string")
    assert X.edge_scores(truth, edges, m).first().asDict() == {"links": 1.0, "kinds": 1.0}
    gold = spark.createDataFrame([("k", "<1>"), ("k", "<2>")], "truth_id string, message_id string")
    cs = spark.createDataFrame([("c", "A", "<1>"), ("c", "B", "<2>")], "conflict_id string, side string, message_id string")
    assert X.conflicts_surfaced(cs, gold).first()["surfaced"]
    tables.replace(dec.selectExpr("decision_id src", "cluster_id dst", "'k' kind", "'' scope", "'' aspect", "'' rationale"), str(tmp_path / "a"), "decision_edges")
    assert tables.snapshot(spark, str(tmp_path / "a"), str(tmp_path / "b")) == ["decision_edges"]
    tables.write_report([{"name": "recall", "value": 0.96, "target": 0.9, "met": True}], str(tmp_path / "r"))
    assert "| recall | 0.96 | 0.9 | yes |" in (tmp_path / "r" / "scorecard.md").read_text()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.eml").write_bytes(eml("one"))
    (src / "b.eml").write_bytes(eml("one again"))
    (src / "c.eml").write_bytes(eml("two", Message_ID="<9@x>"))
    q = ingest.mail_stream(spark, str(src)).writeStream.format("memory").queryName("mail").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["message_id"] for r in spark.table("mail").collect()} == {"<1@x>", "<9@x>"}
    ev = spark.createDataFrame([("r", 1, "stage_start", "parse", ""), ("r", 2, "run_done", None, ""), ("r", 3, "late", None, ""), ("s", 1, "stage_start", "parse", "")], DDL["events"])
    assert [r["seq"] for r in ingest.replay(ev, "r").collect()] == [1, 2] and ingest.recent(ev, "r", 2).count() == 2
    assert ingest.progress(ev).count() == 2
