"""Replies, service answers and small record rules against hand-made rows."""

import json

from pyspark.sql import functions as F

from cairn.operators import parsing as P

BAD = [None, "", "no json", "[", "{}"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_replies(spark):
    fenced = lambda o: "```json\n" + json.dumps(o) + "\n```"
    o = one(spark, 'Here: {"title": " T ", "overview": "", "keyTopics": ["a", " ", "b"]} done', P.overview)
    assert (o.title, o.overview, o.topics, o.questions) == ("T", "", ["a", "b"], [])
    assert all(one(spark, b, P.overview) is None for b in BAD)
    l = one(spark, fenced({"lesson": " x  y ", "triggers": ["A", ""], "tools": [" t "], "origin": "O.com", "confidence": 0.8}), P.lesson)
    assert (l.lesson, l.triggers, l.tools, l.origin) == ("x y", ["a"], ["t"], "o.com")
    assert one(spark, fenced({"lesson": "x", "triggers": ["a"], "confidence": 0.6}), P.lesson) is None
    assert one(spark, fenced(["a ", "b"]), lambda x: P.summaries(x, F.lit(2))) == ["a", "b"]
    assert one(spark, fenced(["a", " "]), lambda x: P.summaries(x, F.lit(2))) is None
    assert one(spark, fenced(["a"]), lambda x: P.summaries(x, F.lit(2))) is None
    v = one(spark, fenced({"verdict": " Revise ", "issues": "i"}), P.verdict)
    assert (v.revise, v.issues) == (True, "i")
    assert all(not one(spark, b, P.verdict).revise for b in BAD)
    assert one(spark, fenced({"title": "t", "summary": " "}), P.thread_meta).asDict() == {"title": "t", "summary": None}
    thread = json.dumps({"app": "a", "kind": "conversation", "conversation": {"messages": [{"r": 1}], "conversation": []}, "labels": [{"id": "1", "name": "n", "color": "c"}, {"id": "2"}]})
    assert one(spark, thread, lambda x: P.thread_file(x, ["a"])).messages == ['{"r":1}']
    assert one(spark, thread, lambda x: P.thread_file(x, ["b"])) is None
    assert [r.id for r in one(spark, thread, P.thread_labels)] == ["1"] and one(spark, None, P.thread_labels) == []


def test_service_answers(spark):
    box = lambda n, a: {"emailAddress": {"name": n, "address": a}}
    event = {"id": "e", "subject": " ", "start": {"dateTime": "2024-01-02T03:04:05"}, "end": {"dateTime": "2024-01-02T04:00:00Z"}, "organizer": box("N", "n@x"),
             "attendees": [box("A", "a@x"), {**box("", "b@x"), "type": "optional"}], "body": {"contentType": "html", "content": "<p>See https://teams.live.com/meet/1.</p>"}}
    df = spark.createDataFrame([(1, json.dumps({"value": [event, {"id": "no times"}]})), (2, None), (3, "junk")], "k int, j string")
    (r,) = P.calendar_events(df, "j", ["k"]).collect()
    assert (r.k, r.subject, r.start, r.end, r.organizer, r.required, r.optional, r.meeting) == (
        1, "(no subject)", "2024-01-02T03:04:05Z", "2024-01-02T04:00:00Z", "N <n@x>", ["A <a@x>"], ["b@x"], "https://teams.live.com/meet/1",
    )
    mail = {"id": "m", "subject": "S", "from": box("N", "n@x"), "toRecipients": [box(None, "t@x")], "receivedDateTime": "2024-01-02T03:04:05Z", "body": {"contentType": "text", "content": " hi "}}
    (r,) = P.mail_messages(spark.createDataFrame([(1, json.dumps({"value": [mail]})), (2, "{}")], "k int, j string"), "j", ["k"]).collect()
    assert r.text == "From: N <n@x>\nTo: t@x\nSubject: S\nDate: 2024-01-02T03:04:05Z\n\nhi"
    index = [{"name": " A ", "file": "a/S.md"}, {"name": "a", "url": "https://z/1"}, {"name": "b"}, {"name": "c", "url": "HTTPS://z/2", "description": " d "}]
    df = spark.createDataFrame([(1, json.dumps(index)), (2, json.dumps({"playbooks": index[3:]})), (3, "junk")], "k int, j string")
    got = sorted((r.k, r.name, r.description, r.url) for r in P.playbooks(df, "j", F.lit("https://h/x/i.json?q"), ["k"]).collect())
    assert got == [(1, "A", "", "https://h/x/a/S.md"), (1, "c", "d", "HTTPS://z/2"), (2, "c", "d", "HTTPS://z/2")]


def test_addresses_and_mail(spark):
    assert one(spark, " https://github.com/o/r/blob/main/a/b.md ", P.raw_file_url) == "https://raw.githubusercontent.com/o/r/main/a/b.md"
    assert [one(spark, u, P.is_https) for u in ("https://a", "http://a", "", None)] == [True, False, False, False]
    assert [one(spark, h, lambda x: P.host_in(x, ["work.com"])) for h in ("a.Work.com", "work.com", "network.com")] == [True, True, False]
    assert one(spark, "ftp://a/b", lambda x: P.page_ref(x, F.lit("t"))) is None
    assert one(spark, "https://A.b/c", lambda x: P.page_ref(x, F.lit(" t "))).asDict() == {"url": "https://A.b/c", "title": "t", "host": "a.b"}
    assert [one(spark, t, P.file_type) for t in (" .PDF", "a b", None)] == ["pdf", None, None]
    m = one(spark, "Objet: Un / deux\nDe: a@b\n\ncorps", lambda x: P.dragged_mail(F.lit(None).cast("string"), x))
    assert (m.subject, m.sender, m.date) == ("Un / deux", "a@b", None)
    made = spark.createDataFrame([("Subject: A/B: c\nFrom: n\nDate: d\n\nbody",)], "x string").select(P.dragged_mail(F.lit(""), F.col("x")).alias("m"))
    made = made.select(P.mail_file_name(F.col("m.subject")).alias("f"), P.mail_markdown(F.col("m")).alias("t")).first()
    assert made.f == "A B c.md" and made.t.startswith("# A/B: c\n\n**From:** n  \n**Date:** d\n\n---\n\n") and made.t.endswith("body\n")
    assert one(spark, None, P.mail_file_name) == "email.md"


def test_record_rules(spark):
    nodes = P.memory_from_entries(spark.createDataFrame([("1", "a b c d e f g", 1, 2), ("2", "x", 1, 2)], "id string, text string, created_at int, updated_at int"))
    nodes = nodes.withColumn("provenance", F.array(F.lit("p0")))
    seen = spark.createDataFrame([("1", "short", 0.95, 0.1, f"p{k}", k) for k in range(1, 13)] + [("9", "z", 1.0, 1.0, "p", 1)], "id string, summary string, confidence double, durability double, source string, seq int")
    got = {r.id: r for r in P.confirm_memory(nodes, seen, F.lit(7)).collect()}
    assert set(got) == {"1", "2"} and got["1"].label == "a b c d e f…" and got["1"].summary == "a b c d e f g"
    assert (got["1"].confidence, got["1"].durability, got["1"].updated_at, got["2"].updated_at) == (0.95, 0.7, 7, 2)
    assert got["1"].provenance == [f"p{k}" for k in range(3, 13)] and got["2"].provenance == ["p0"]
    runs = spark.createDataFrame([(1, False, False, True, False, None), (2, True, True, True, False, None), (3, True, False, True, False, None), (4, True, False, False, True, None), (5, True, False, False, False, "e")],
                                 "k int, enabled boolean, busy boolean, ok boolean, ask boolean, error string")
    c = [F.col(x) for x in ("enabled", "busy", "ok", "ask", "error")]
    rows = runs.select("k", P.settle_run(*c, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("s")).orderBy("k").collect()
    assert [(r.s.status, r.s.next is not None) for r in rows] == [(None, False), ("deferred", True), ("ok", False), ("needs_approval", False), ("error", False)]
    assert rows[4].s.error == "e" and rows[2].s.error is None
    pair = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "a int, b int")
    assert [r.m for r in pair.select(P.counts_moved([F.col("a")], [F.col("b")]).alias("m")).collect()] == [False, True, True]
    ev = spark.createDataFrame([(1, k, "a.x.com" if k % 2 else "y.com") for k in range(20)], "rec int, seq int, host string")
    assert [r.seq for r in P.host_events(ev, F.lit("x.com"), ["seq"], ["rec"], 3).orderBy("seq").collect()] == [15, 17, 19]
    assert one(spark, "click", lambda x: P.action_line(x, F.lit("b"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "Click b"
    assert one(spark, "input", lambda x: P.action_line(x, F.lit("b"), F.lit("k"), F.lit(" "))) == "Type into b"
    assert one(spark, "m:7", lambda x: P.memory_id(x, "m:")) == "7" and one(spark, "http:7", lambda x: P.memory_id(x, "m:")) is None
    assert one(spark, "web", lambda x: P.source_allowed(x, ["web"], F.lit(True), F.lit(False))) is False
    assert one(spark, "r", lambda x: P.repository_allowed(x, F.array(F.lit("r")), F.lit(True))) is True
    assert one(spark, "2024-01-01T00:00:00", lambda x: P.older_than(x, F.lit("2024-01-01 00:01:00"), 30)) is True
    d = one(spark, "2024-01-05", lambda x: P.day_range(x, F.lit(None).cast("string"), F.lit("2024-02-01")))
    assert str(d.start) == "2024-01-05 00:00:00" and str(d.end) == "2024-02-08 00:00:00"
    assert one(spark, "https://a/b#c", lambda x: P.web_doc_id(x, F.lit("t"))) == one(spark, "https://a/b", lambda x: P.web_doc_id(x, F.lit("t")))
