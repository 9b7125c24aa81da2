"""From records and a model's answers to decisions, the index, questions and uploads, on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioframe.operators import ledger as L
from folioframe.operators import retrieval as V
from folioframe.operators import serving as S
from folioframe.operators import threads as TH
from folioframe.plans.scratch import Scratch
from folioframe.schemas import ANSWERS, DDL
from folioframe.sources import mailbox, tables


def struct(name):
    """An answer's schema as a struct."""
    out, depth = [], 0
    for c in ANSWERS[name].replace(", ", ",") :
        depth += (c == "<") - (c == ">")
        out.append(":" if c == " " and depth == 0 else c)
    return f"struct<{''.join(out)}>"


def answer(**given):
    base = {"cluster_topic": "t", "decisions": [], "edges": [], "conflicts": [], "current_state": "s", "non_decisions": []}
    return json.dumps(base | given)


def decided(temp, merged, evidence, **given):
    base = {"decision_id_temp": temp, "canonical_text": f"text {temp}", "decided_by": ["Ann"], "decided_at": "2026-01-02", "rationale": None, "alternatives": [], "decision_type": "explicit", "status": "active", "authority_flag": False, "authority_note": None, "merged_record_ids": merged, "confidence": 0.9, "evidence": evidence}
    return base | given


def said(mail, quote, role="decision"):
    return {"message_id": mail, "quote": quote, "role": role}


@pytest.fixture(scope="module")
def world(spark):
    at = lambda d: dt.datetime(2026, 1, d, 12)
    emails = spark.createDataFrame(
        [(f"<{i}>", t, at(i), "+0100", text, "") for i, t, text in (
            (1, "T-a", "We paint the shed green."), (2, "T-a", "No, the shed shall be blue."), (3, "T-b", "The fence costs nine hundred."), (4, "T-b", "Buy oak, says Kim."), (5, "T-c", "The gate is to be iron."),
        )], "message_id string, thread_id string, sent_at timestamp, sent_tz string, new_text string, fwd_text string")
    rec = lambda i, t, c, stance="final", note=None: (f"R-{i}", t, "topic", f"do {i}", stance, "implicit", ["Ann"], f"2026-01-0{i}", None, [], None, None, note, 0.5, c)
    recs = spark.createDataFrame([rec(1, "T-a", "C-1"), rec(2, "T-a", "C-1"), rec(3, "T-b", "C-2"), rec(4, "T-b", "C-2", "proposed"), rec(5, "T-c", "C-3")], DDL["records"])
    ev = spark.createDataFrame([(1, "record", "R-1", "<1>", "paint the shed green", "decision", True), (2, "record", "R-2", "<2>", "shed shall be blue", "decision", True), (3, "record", "R-3", "<3>", "costs nine hundred", "decision", True), (4, "record", "R-4", "<4>", "Buy oak", "proposal", False), (5, "record", "R-5", "<5>", "gate is to be iron", "decision", True)], DDL["evidence"])
    return emails, recs, ev


def parsed(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, j string").select("cluster_id", F.from_json("j", ANSWERS["reconcile"]).alias("answer"))


def by(frame, *keys):
    return {tuple(r[k] for k in keys): r for r in frame.collect()}


def test_aliases(world):
    r, e = L.prompt_aliases(world[1], world[2], world[0])
    assert {(x["cluster_id"], x["alias"], x["record_id"]) for x in r.where("cluster_id = 'C-1'").collect()} == {("C-1", "r1", "R-1"), ("C-1", "r2", "R-2")}
    # R-4 has no verified quote, yet its thread is shown
    assert {(x["alias"], x["message_id"]) for x in e.where("cluster_id = 'C-2'").collect()} == {("e1", "<3>"), ("e2", "<4>")}
    few = L.prompt_aliases(world[1], world[2], world[0], most=1)[1]
    assert {x["message_id"] for x in few.where("cluster_id = 'C-2'").collect()} == {"<3>"}


def test_reconciled(spark, world):
    emails, recs, ev = world
    first = parsed(spark, [
        ("C-1", answer(
            decisions=[decided("d1", ["r1"], [said("[e1]", "paint the SHED green")]), decided("d2", [" r2 "], [said("e2", "never said at all here")], decision_type="odd")],
            edges=[{"src": "d2", "dst": "d1", "kind": "supersedes", "scope": "full", "aspect": None, "rationale": None}, {"src": "d2", "dst": "gone", "kind": "amends", "scope": "full", "aspect": None, "rationale": None}],
            conflicts=[{"topic": "colour", "summary": "green or blue", "sides": [{"claimant": "Ann", "claim": "green", "evidence": [said("e1", "shed green")]}, {"claimant": "Bob", "claim": "blue", "evidence": [said("e2", "shall be blue")]}, {"claimant": "Zed", "claim": "red", "evidence": [said("e2", "it must be red now")]}]}],
        )),
        ("C-2", answer(decisions=[decided("d1", [], [said("e1", "no such words were written")])])),
        ("C-3", answer(decisions=[decided("d9", [], [])])),
    ])
    out = L.reconcile(recs, ev, emails, first)
    got = by(out["decisions"], "cluster_id", "temp_id")
    # d2's quote doesn't hold, so it stands on its record's; C-2's answer has nothing to stand on and leaves R-3 out; C-3 needs none
    assert set(got) == {("C-1", "d1"), ("C-1", "d2"), ("C-1", "dc1"), ("C-2", "dr1"), ("C-3", "d1")}
    assert got["C-1", "d2"]["decision_type"] == "implicit" and got["C-1", "d2"]["sources"] == ["R-2"] and got["C-2", "dr1"]["canonical_text"] == "do 3"
    dispute = got["C-1", "dc1"]
    assert (dispute["status"], dispute["decided_at"], dispute["decided_by"], dispute["confidence"], dispute["sources"]) == ("contested", "2026-01-02", ["Ann", "Bob"], 0.5, ["R-1", "R-2"])
    proof = {(r["cluster_id"], r["temp_id"], r["message_id"], r["quote"]) for r in out["evidence"].collect()}
    assert ("C-1", "d1", "<1>", "paint the shed green") in proof and ("C-1", "d2", "<2>", "shed shall be blue") in proof and ("C-3", "d1", "<5>", "gate is to be iron") in proof
    assert [(r["src"], r["dst"]) for r in out["edges"].collect()] == [("d2", "d1")]
    assert out["conflicts"].count() == 1 and {r["claimant"] for r in out["sides"].collect()} == {"Ann", "Bob"}
    ledger, edges, con, sides = L.number_ledger(out["decisions"], out["edges"], out["conflicts"], out["sides"])
    assert sorted(r["status"] for r in ledger.collect()) == ["active", "active", "active", "contested", "superseded"] and edges.count() == 1
    assert [r["conflict_id"] for r in con.collect()] == ["CON-001"] and sorted(r["side"] for r in sides.collect()) == ["A", "B"]


def test_second_answers(spark, world):
    emails, recs, ev = world
    bare = parsed(spark, [("C-1", answer())])
    named = parsed(spark, [("C-1", answer(decisions=[decided("d1", ["r1"], [])], non_decisions=[{"record_ids": ["r2"], "reason": "x"}]))])
    aliases = L.prompt_aliases(recs, ev, emails)[0]
    assert {r["record_id"] for r in L.uncovered(recs, bare, aliases).collect()} == {"R-1", "R-2"}
    assert L.uncovered(recs, named, aliases).count() == 0
    assert len(L.better_answers(bare, named, recs, aliases).first()["answer"]["decisions"]) == 1
    assert len(L.better_answers(named, bare, recs, aliases).first()["answer"]["decisions"]) == 1
    got = by(L.reconcile(recs, ev, emails, bare, named)["decisions"], "cluster_id", "temp_id")
    assert ("C-1", "d1") in got and ("C-1", "dr1") not in got


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ledger"))
    mail = lambda i, text, fwd="": (f"<{i}>", None, [], "ann@x", "Ann", [], [], [], dt.datetime(2026, 1, i, 9), "+0000", f"s{i}", text, "", fwd, None, text, [], "f")
    emails = spark.createDataFrame([mail(1, "We paint the shed green in June."), mail(2, "The fence is oak."), mail(3, "fyi", "The roof needs slate tiles.")], DDL["emails"])
    emails = emails.withColumn("thread_id", F.lit("T-1"))
    decs = spark.createDataFrame([("DEC-1", "C-1", "Paint the shed green", ["Ann"], "2026-01-01", "cheap", [], "explicit", "active", False, None, 0.9), ("DEC-2", "C-1", "Oak for the fence", ["Ann"], "2026-01-02", None, [], "explicit", "active", False, None, 0.9)], DDL["decisions"])
    edges = spark.createDataFrame([("DEC-2", "DEC-1", "refines", "full", None, None)], DDL["decision_edges"])
    ev = spark.createDataFrame([(1, "decision", "DEC-1", "<1>", "paint the shed green", "decision", True), (2, "decision", "DEC-2", "<2>", "fence is oak", "decision", True)], DDL["evidence"])
    for name, df in (("decisions", decs), ("decision_edges", edges), ("evidence", ev)):
        tables.replace(df, root, name)
    emails.write.parquet(f"{root}/emails")
    return root, emails, decs


def test_index_and_question(spark, ledger, tmp_path, monkeypatch):
    root, emails, decs = ledger
    index = str(tmp_path / "index")
    none = spark.createDataFrame([], DDL["embed_cache"])
    built = V.index_ledger(emails, decs, none, index)
    assert built["passages"].count() == 4 and built["fresh"].count() == 6  # the short mail and its forwarded part are passages of their own
    again = V.index_ledger(emails, decs, built["fresh"].cache(), str(tmp_path / "again"))
    assert again["fresh"].count() == 0
    seeds, near = V.retrieve_ledger(spark, index, "What colour will the shed be painted?")
    assert seeds.first()["decision_id"] == "DEC-1" and near.first()["passage_id"].startswith("<1>")
    monkeypatch.setitem(DDL, "emails", DDL["emails"] + ", thread_id string")
    reply = {"status": "found", "answer_md": "The shed is painted green [^1]. It also rains. Oak it is [^2].", "citations": [{"n": 1, "message_id": "<1>", "quote": "paint the shed green"}, {"n": 2, "message_id": "<1>", "quote": "never stood there"}], "decision_ids": ["DEC-1"], "confidence": "high", "caveats": [], "closest": []}
    better = reply | {"answer_md": "The shed is painted green [^1].", "citations": reply["citations"][:1]}
    frame = lambda r: spark.createDataFrame([("q1", json.dumps(r))], "answer_id string, j string").select("answer_id", F.from_json("j", ANSWERS["answer"]).alias("answer"))
    scratch = Scratch(spark, "ask")
    told = S.ask(spark, root, index, scratch, "What colour will the shed be painted?", frame(reply)).first()
    assert told["answer_md"] == "The shed is painted green [^1]." and told["confidence"] == "low" and told["verification_errors"] and "2 statement(s)" in told["caveats"][0]
    told = S.ask(spark, root, index, scratch, "What colour will the shed be painted?", frame(reply), frame(better)).first()
    assert told["verification_errors"] == [] and told["confidence"] == "medium" and [c["n"] for c in told["citations"]] == [1] and told["decision_ids"] == ["DEC-1"]
    assert sorted(r["id"] for r in tables.read(spark, root, "qa_log").collect()) == [1, 2]
    assert S.ask(spark, root, index, scratch, "  ", frame(reply)) is None
    nothing = frame(reply | {"answer_md": "There is no recorded decision on paint. More talk.", "citations": [], "decision_ids": []})
    told = V.answered(nothing, None, emails, decs).first()
    assert told["status"] == "no_decision" and told["answer_md"] == "There is no recorded decision on paint."


def test_ingest(spark, tmp_path):
    eml = lambda i: (f"From: Ann <ann@x>\nTo: b@x\nSubject: s{i}\nDate: Mon, 05 Jan 2026 10:0{i}:00 +0100\nMessage-ID: <{i}@x>\n\nbody {i}\n").encode()
    files = spark.createDataFrame([("a/1.eml", eml(1)), ("a/2.EML", eml(2)), ("b/1.eml", eml(1)), ("c.txt", b"no")], "path string, content binary")
    root = str(tmp_path / "db")
    assert S.ingest(files, root, "r0", busy=True) is None and S.ingest(files.where("path = 'c.txt'"), root, "r0") is None
    emails = S.ingest(files, root, "r1")
    assert sorted(r["message_id"] for r in emails.collect()) == ["<1@x>", "<2@x>"]
    run = tables.read(spark, root, "runs").first()
    assert (run["n_in"], run["n_out"], json.loads(run["notes"])["duplicates"]) == (3, 2, 1)
    assert [r["code"] for r in S.accepted_uploads(files.selectExpr("path name").where("path = 'c.txt'")).collect()] == [400]
    assert {r["code"] for r in S.accepted_uploads(files.selectExpr("path name"), demo=True).collect()} == {409}
    assert S.latest_report(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "r.json").write_text('{"recall": 0.9}')
    assert S.latest_report(spark, str(tmp_path / "r.json")).first()["recall"] == 0.9


def test_prompts(spark):
    m = spark.createDataFrame([("T", "<1>", None, "Ann", "a@x", dt.datetime(2026, 1, 1), "hello", "", "old words"), ("T", "<2>", "<1>", "Bob", "b@x", dt.datetime(2026, 1, 2), "yes", "", "> hello")], "thread_id string, message_id string, in_reply_to string, from_name string, from_addr string, sent_at timestamp, new_text string, fwd_text string, quoted_text string")
    text = TH.extract_prompt(m, spark.createDataFrame([("T", "Roof"), ("T", "Fence")], "thread_id string, subject string"), "- Ann: boss").first()["text"]
    assert text.startswith("PEOPLE\n- Ann: boss\n\nRELATED THREADS\n- Fence\n- Roof\n\nTHREAD\n[m1] Ann") and "old words" in text and "> hello" not in text


def test_mailboxes_without_a_file(tmp_path):
    one = b"Subject: a\nMessage-ID: <1@x>\n\nit is text\nFrom here on\n"
    box = b"From x Mon\n" + one + b"\nFrom y Tue\n" + one.replace(b"<1", b"<2") + b"\n"
    parts = list(mailbox._members("m.mbox", box))
    assert [n for n, _ in parts] == ["m.mbox#0", "m.mbox#1"] and b"From here on" in parts[0][1]
    assert list(mailbox._members("m.mbox", b"")) == []
