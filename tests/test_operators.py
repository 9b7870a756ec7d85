import pytest
from pyspark.sql import functions as F

from cairn.functions import text as TX
from cairn.functions import urls as U
from cairn.functions import vectors as V
from cairn.operators import chunking, graph, memory, records, retrieval
from cairn.sources import readers, repository, sinks
from cairn.sources.repository import Repository, RevisionConflict, hash_embedding
from cairn.streaming import streams


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_text(spark):
    assert one(spark, TX.tokens(F.lit("The End. v2.3. A_b"))) == ["the", "end.", "v2.3.", "a_b"]
    assert one(spark, TX.fnv1a(F.lit("abc"))) == 0x1A47E90B
    assert one(spark, TX.citation_ids(F.lit("x [[a:1, b]] y [[b;c d]] [[e]]"))) == ["a:1", "b", "e"]
    assert one(spark, TX.clip(F.lit("one two three"), 9)) == "one two…"
    assert one(spark, TX.clip(F.lit("a" * 61), 60)) == "a" * 59 + "…" and one(spark, TX.clip(F.lit("a" * 60), 60)) == "a" * 60
    for said, want in (("/research arctic  lanes", "arctic lanes"), ("/research", "research"), (" /Web-Page ", "Web-Page"), ("no /research", "no /research"), ("/a/b c", "/a/b c"), ("", "")):
        assert one(spark, TX.title(F.lit(said))) == want
    for said, want in (
        ("client_secret=abcdef&x=1", "client_secret=[redacted]&x=1"), ('{"id_token": "abcdef"}', '{"id_token":"[redacted]"}'), ("key glpat-abcdefghijkl.", "key [redacted]."),
        ("xai-0123456789abc", "[redacted]"), ("bearer abcdefghijk==", "[redacted]"), ("gho_0123456789", "[redacted]"), ("code=abc", "code=abc"), ("device_code=abcd,", "device_code=[redacted],"), ("task-0123456789ab", "task-0123456789ab"),
    ):
        assert one(spark, TX.redact(F.lit(said))) == want
    assert one(spark, TX.front_matter(F.lit("---\nname: x\ntags: a, b\n---\nbody"))) == {"name": "x", "tags": "a, b"}
    assert one(spark, TX.bump_version(F.lit("1.2"))) == "1.2.1"
    assert one(spark, TX.file_kind(F.lit("a/b.PDF"))) == "pdf"
    assert one(spark, TX.strip_html(F.lit("<p>a&nbsp;<b>b</b></p><script>x</script>c"))) == "a b\nc"


def test_urls(spark):
    assert one(spark, U.normalize_url(F.lit("HTTP://Ex.org/A/?q#f"))) == "http://ex.org/A"
    assert one(spark, U.host_matches(F.lit("a.b.c"), F.lit("b.c")))
    assert not one(spark, U.host_matches(F.lit("ab.c"), F.lit("b.c")))


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(-4.0))
    assert one(spark, V.normalize(v)) == pytest.approx([0.6, -0.8])
    assert one(spark, V.quantize(v, F.array(F.lit(4.0), F.lit(4.0)))) == [95, -127]
    assert one(spark, V.normalize(F.array(F.lit(0.0)))) == [0.0]
    assert V.recommended_bits(64) == 0 and V.recommended_bits(1000) == 7


def test_chunks():
    text = "word " * 400
    cut = chunking.cut_chunks(text)
    assert all(len(c) <= 800 for c in cut) and chunking.cut_chunks("") == [] and chunking.cut_chunks(None) == []
    # a paragraph past the middle wins over a later sentence, and one before the middle does not
    assert chunking.cut_chunks("a" * 500 + "\n\n" + "b" * 100 + ". " + "c" * 900)[0] == "a" * 500
    assert chunking.cut_chunks("a" * 300 + "\n\n" + "b" * 300 + ". " + "c" * 900)[0] == "a" * 300 + "\n\n" + "b" * 300 + "."
    assert [len(c) for c in chunking.cut_chunks("x" * 2000)] == [800, 800, 640]


def test_sentences(spark):
    cut = lambda t: [(s.start, s.end, s.text) for s in one(spark, chunking.sentences_of(F.lit(t)))]
    assert cut("One. Two three!\nFour") == [(0, 4, "One."), (5, 15, "Two three!"), (16, 20, "Four")]
    assert [s[2] for s in cut('He said "go." (Then left.) What?! v2.3 ok')] == ['He said "go."', "(Then left.)", "What?!", "v2.", "3 ok"]
    assert cut("  \n ") == [] and cut("") == [] and [s[2] for s in cut("line one\nline two")] == ["line one\nline two"]


def test_text_cleaning(spark):
    assert one(spark, TX.clean_text(F.lit("  a \t b  \n\n\nc \n d  "))) == "a b\nc\n d"
    assert chunking.evenly(10, 3) == [0, 5, 9] and chunking.evenly(2, 5) == [0, 1]


def test_sentence_ids(spark):
    docs = spark.createDataFrame([(1, "One  sentence. Über zwei! \U0001f600"), (2, None), (3, "")], "doc_id long, text string")
    s = chunking.sentence_table(chunking.chunk_table(docs))
    want = TX.sentence_id(F.col("doc_id"), F.col("chunk_idx"), F.col("sentence_idx"), F.col("text"))
    got = s.withColumn("want", want).collect()
    assert len(got) == 3 and all(r.sentence_id == r.want for r in got)


def test_policy(spark):
    """attended, action, trust, capability, approved, blocked and what is decided."""
    cases = [
        (True, "financial_legal", "local", False, True, False, "deny"), (False, "read", None, False, False, False, "allow"), (False, "read", None, False, False, True, "deny"),
        (False, "low_risk_write", "local", True, True, False, "deny"), (False, "external_comms", "enterprise", True, False, False, "deny"), (False, "read", "community", True, False, False, "deny"),
        (False, "read", "enterprise", True, False, False, "allow"), (True, "record_modification", None, False, True, False, "allow"), (True, "destructive", "local", False, True, False, "needs_approval"),
        (True, "read", "verified", True, False, False, "needs_approval"), (True, "read", "verified", False, False, False, "allow"), (True, "low_risk_write", None, False, False, True, "allow"),
        (True, "external_comms", "local", True, False, False, "needs_approval"), (True, "read", "odd", True, False, False, "needs_approval"),
    ]
    df = spark.createDataFrame(cases, "attended boolean, action string, trust string, capability boolean, approved boolean, blocked boolean, want string")
    got = df.select("want", records.policy(*[F.col(c) for c in ("action", "trust", "attended", "capability", "approved", "blocked")]).alias("got"))
    assert [r.got for r in got.collect()] == [c[-1] for c in cases]


def test_auth_state(spark):
    cases = [
        ("blocked", "http://a/", "", "", False, False, "blocked"), ("ok", "http://a/", "t", "x" * 60, True, False, "auth_required"), ("ok", "http://a/", "t", "x" * 60, False, True, "auth_required"),
        ("ok", "https://x.okta.com/", "t", "x" * 60, False, False, "auth_required"), ("ok", "http://a/login", "Sign in", "x" * 60, False, False, "authenticated"),
        ("ok", "http://a/login", "t", "Your session has expired, go on" + "x" * 60, False, False, "auth_required"), ("ok", "http://a/b", "t", "please sign in" + "x" * 60, False, False, "authenticated"),
        ("ok", "http://a/", "t", "short", False, False, "unknown"),
    ]
    df = spark.createDataFrame(cases, "status string, url string, title string, text string, password boolean, form boolean, want string")
    got = df.select(records.auth_state(*[F.col(c) for c in ("status", "url", "title", "text", "password", "form")]).alias("got"))
    assert [r.got for r in got.collect()] == [c[-1] for c in cases]
    assert one(spark, records.provider(F.lit("https://id.atlassian.com/x"))) == "Atlassian"


def test_ranked(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = records.ranked(df, ["g", F.desc("k")], "r").collect()
    assert [(x.g, -x.k) for x in sorted(got, key=lambda x: x.r)] == sorted((x.g, -x.k) for x in got) and sorted(x.r for x in got) == list(range(1, 1001))
    assert records.ranked(df.limit(0), ["k"]).count() == 0
    total = {r.k: r.t for r in records.running_total(df, [F.desc("k")], F.col("k"), "t").collect()}
    assert total == {k: sum(range(k, 1000)) for k in range(1000)}


def test_spans(spark):
    t = spark.createDataFrame(
        [(1, 0, "B-PER", 0, 3, 1.0), (1, 1, "I-PER", 4, 8, 0.5), (1, 2, "O", 9, 10, 0.0), (1, 3, "B-PER", 11, 12, 0.8), (1, 4, "B-LOC", 13, 14, 0.4)],
        "window_id int, pos int, tag string, start int, end int, score double",
    )
    spans = chunking.bio_spans(t)
    assert sorted(map(tuple, spans.select("label", "start", "end", "score").collect())) == [("LOC", 13, 14, 0.4), ("PER", 0, 8, 0.75), ("PER", 11, 12, 0.8)]
    s = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 10, 20)], "window_id int, sentence_idx int, start int, end int")
    assert {(r.start, r.sentence_idx) for r in chunking.spans_in_sentences(spans, s).collect()} == {(0, 0), (11, 1), (13, 1)}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "src long, dst long")
    assert dict(map(tuple, graph.degree(e).collect()))[3] == 3
    labels = graph.label_rounds(e)
    assert labels.count() == 6
    assert graph.communities_by_label(labels, least=1).count() >= 1
    # in place, in order of ids: a node sees the new labels of those before it, so the bridge carries the first triangle's
    assert dict(map(tuple, graph.label_propagation(e).collect())) == dict.fromkeys(range(1, 7), 2)
    assert dict(map(tuple, graph.label_propagation(e.where("src <> 3 or dst <> 4")).collect())) == {1: 2, 2: 2, 3: 2, 4: 5, 5: 5, 6: 5}
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert graph.touching(e, ids).count() == 3 and graph.induced(e, ids).count() == 1
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(i, "t") for i in range(1, 7)], "id long, type string")
    assert sorted(map(tuple, graph.greedy_merge(nodes, pairs).collect())) == [(2, 1), (6, 5)]
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    c = graph.lsh_candidates(vecs, 2, 2)
    assert {(r.a, r.b) for r in graph.similar_pairs(vecs, c, 0.9).collect()} == {(1, 2)}


def test_merge(spark):
    n = spark.createDataFrame(
        [(0, "n0", "Alpha  One", "org", ["s1"], ["d1"], ["A1"], "short"), (1, "n1", "alpha one", "person", ["s2", "s1"], ["d1"], [], "a longer one")],
        "seq int, id string, label string, type string, evidence array<string>, doc_ids array<string>, aliases array<string>, summary string",
    )
    m = graph.merge_nodes(n).first()
    assert (m.label, m.type, m.summary, m.evidence, m.aliases) == ("Alpha  One", "org", "a longer one", ["s1", "s2"], ["A1"])
    many = spark.range(300).select(F.col("id").alias("seq"), F.lit("x").alias("label"), F.lit("t").alias("type"), F.array(F.concat(F.lit("e"), F.col("id") % 70), F.lit("e0")).alias("evidence"), F.array().cast("array<string>").alias("doc_ids"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("summary"), F.lit("").alias("id"))
    assert graph.merge_nodes(many).first().evidence == [f"e{k}" for k in range(50)]
    e = spark.createDataFrame([("a", "b", "r", ["x"], 0), ("c", "b", "r", ["y"], 1), ("a", "c", "r", ["z"], 2)], "src string, dst string, relation string, evidence array<string>, seq int")
    into = spark.createDataFrame([("c", "a")], "id string, into string")
    assert [(r.src, r.dst, r.evidence) for r in graph.redirect(e, into).collect()] == [("a", "b", ["x", "y"])]


def test_records(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    assert dict(map(tuple, records.sync_diff(old, new, "k", ["v"]).collect())) == {1: "unchanged", 2: "changed", 3: "removed", 4: "new"}
    assert {tuple(r) for r in records.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "x"), (3, "c"), (4, "d")}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "key string, target string")
    got = records.crawl(spark.createDataFrame([("a",)], "key string"), links, 2, 10)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    m = spark.createDataFrame([(1, 1, "assistant", "c1", ""), (1, 2, "tool", "c1", "ok"), (1, 3, "assistant", "c2", "")], "conv_id int, seq int, role string, call_id string, text string")
    assert [(r.seq, r.role) for r in records.repair_pairs(m).orderBy("seq").collect()][-1] == (3.5, "tool")


def test_memory(spark):
    r = spark.createDataFrame([('```{"memories":[{"label":"x","confidence":2},{"label":" "}]}```',), ("junk",)], "reply string")
    got = memory.coerce_reflection(r, "reply").collect()
    assert [(g.label, g.confidence, g.durability) for g in got] == [("x", 1.0, 0.5)]


def test_evaluate(spark):
    cases = spark.createDataFrame([("a", [1, 2], 5), ("b", [3], 5)], "id string, relevant array<long>, n_items long")
    ranks = spark.createDataFrame([("a", [2, 9, 1])], "id string, ranking array<long>")
    r = retrieval.evaluate(cases, ranks, 1).first()
    assert (r.recall, r.hit, r.mrr, r.invalid) == (0.25, 0.5, 0.5, 1)


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\nnot json\n{"a":2}\n')
    assert readers.json_lines(spark, str(p), "a int").count() == 2
    pages = spark.createDataFrame([(1, "u", "<title>T</title><h1>Head</h1><p>Hi<a href='http://x'>link</a></p><script>no</script>"), (2, "v", None)], "page_id long, url string, html string")
    a, b = readers.pages(pages).orderBy("page_id").collect()
    assert (a.title, a.text, a.links[0].href, a.headings[0].text, b.status) == ("T", "Head\nHilink", "http://x", "Head", "empty")
    v = spark.createDataFrame([("WEBVTT\n\n00:01.000 --> 00:02.500\n<c>Hello</c>\n",)], "vtt string")
    assert [(r.start, r.end, r.caption) for r in readers.captions(v, "vtt").collect()] == [(1.0, 2.5, "Hello")]
    mail = spark.createDataFrame([("From: a@b.c\nTo: d@e.f\nSubject: =?utf-8?q?Caf=C3=A9?=\n\nBody",)], "raw string")
    assert mail.select(readers.parse_mail("raw").alias("m")).first().m.subject == "Café"
    df = spark.createDataFrame([(1, bytearray(b"xy"))], "id int, b binary")
    sinks.backup(df, str(tmp_path / "bk"))
    assert bytes(sinks.restore(spark, str(tmp_path / "bk"), df.schema).first().b) == b"xy"
    spark.createDataFrame([(1, None, "root", None, 0), (2, 1, "page", "http://x", 0)], "id int, parent int, title string, url string, pos int").createOrReplaceTempView("marks")
    assert readers.flatten_tree(spark, "marks").first().path == "/root"


def test_repository(spark, tmp_path):
    repo = Repository(spark, str(tmp_path), "r")
    docs = spark.createDataFrame([(1, "a", "u1", "alpha beta gamma"), (2, "b", "u2", "delta epsilon")], "doc_id long, name string, url string, text string")
    embed = hash_embedding(16)
    assert repo.add(docs, embed, expected=0) == 1
    with pytest.raises(RevisionConflict):
        repo.add(docs, embed, expected=0)
    assert repo.search("alpha", embed(F.lit("alpha")), 1).first().chunk_id == "1:c0"
    assert repo.chunks([2]).count() == repo.sentences([2]).count() == repo.vectors([2]).count() == 1
    repo.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert [r.doc_id for r in repo.docs().collect()] == [2] and repo.chunks().count() == 1


def test_repository_commits(spark, tmp_path, monkeypatch):
    """What a commit that dies has written is never read, and of two writers of one revision the second is refused."""
    repo = Repository(spark, str(tmp_path), "r")
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, name string, url string, text string")
    embed = hash_embedding(8)
    repo.add(docs((1, "a", "u", "alpha beta. Gamma!")), embed, embed_model="hash", kind="notes")
    create = repository.files.create

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(repository.files, "create", die)
    with pytest.raises(RuntimeError):
        repo.add(docs((2, "b", "v", "delta")), embed)
    monkeypatch.setattr(repository.files, "create", create)
    assert repo.revision() == 1 and [r.doc_id for r in repo.documents().collect()] == [1] and repo.chunks().count() == 1
    monkeypatch.setattr(Repository, "revision", lambda self: 0)
    with pytest.raises(RevisionConflict):
        repo.add(docs((3, "c", "w", "other")), embed)
    monkeypatch.undo()
    repo.add(docs((2, "b", "v", "delta"), (4, "d", "x", " \n"), (1, "a", "u", "alpha again")), embed)
    assert sorted(r.doc_id for r in repo.documents().collect()) == [1, 2] and [r.text for r in repo.chunks([1]).collect()] == ["alpha again"]
    assert [r.doc_id for r in repository.rejected(docs((4, "d", "x", " \n"), (5, "e", "y", "z"))).collect()] == [4]
    assert [r.item for r in repo.lexical("Gamma beta").collect()] == [] and [r.item for r in repo.lexical("alpha").collect()] == ["1:c0"]
    with pytest.raises(repository.EmbedderConflict):
        repo.add(docs((6, "f", "z", "zeta")), embed, embed_model="other")
    repo.export(str(tmp_path / "out"))
    hits = {(r.chunk_id, round(r.score, 9)) for r in repo.search("alpha", embed(F.lit("alpha")), 5).collect()}
    copy = Repository(spark, str(tmp_path), "copy")
    copy.restore(str(tmp_path / "out"))
    assert {(r.chunk_id, round(r.score, 9)) for r in copy.search("alpha", embed(F.lit("alpha")), 5).collect()} == hits
    Repository(spark, str(tmp_path), "m").add(docs((1, "a", "u", "alpha")), embed, kind=repository.MEMORY)
    assert sorted((r.name, r.docs, r.chunks, r.kind, r.embed_model) for r in repository.repositories(spark, str(tmp_path)).collect()) == [("copy", 2, 2, "notes", "hash"), ("r", 2, 2, "notes", "hash")]
    repo.delete(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert repo.scales() is None and repo.documents().count() == 0
    repo.add(docs((7, "g", "u", "eta")), embed)
    assert repo.scales() is not None and repo.chunks().count() == 1
    copy.drop()
    assert copy.revision() == 0 and repository.repositories(spark, str(tmp_path)).count() == 1


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:10:00")]
    ev = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    want = {("a", 0), ("a", 60), ("b", 10)}
    minutes = lambda df: {(r.k, r.t.hour * 60 + r.t.minute) for r in df.collect()}
    assert minutes(streams.fire_with_cooldown(ev, "k", "t", 60)) == want
    later = spark.createDataFrame([("z", "2024-01-02 00:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    ev.unionByName(later).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = streams.cooldown_stream(s, "k", "t", 60).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("fired").select(F.col("key").alias("k"), F.timestamp_micros("us").alias("t"))
    assert minutes(got) == want


def test_changes(spark, tmp_path):
    target = str(tmp_path / "t")
    merge = streams.apply_changes(target, "k", ["v"], "at")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, at int, removed boolean")
    state = lambda: sorted((r.k, r.v) for r in streams.changed_state(spark, target, "k").collect())
    assert streams.changed_state(spark, target, "k") is None
    merge(batch(("a", 1, 1, False), ("a", 2, 2, False), ("b", 1, 1, None), ("x", 1, 1, True)), 0)
    assert state() == [("a", 2), ("b", 1)]
    second = batch(("a", 2, 9, False), ("b", 5, 3, False), ("b", 4, 2, False), ("c", 7, 1, False))
    merge(second, 1)
    assert state() == [("a", 2), ("b", 5), ("c", 7)] and spark.read.parquet(f"{target}/epoch=1").count() == 2
    merge(batch(("b", 5, 4, True), ("z", 1, 1, True)), 2)
    assert state() == [("a", 2), ("c", 7)]
    merge(second, 1)  # a batch that comes again
    assert state() == [("a", 2), ("c", 7)]


@pytest.fixture(scope="module")
def library(spark):
    """Five chunks with vectors and a graph that knows of two."""
    from cairn.operators.search_calls import Corpus, StoredGraph

    texts = ["Alpha engines need oil. They turn.", "Beta pumps move water.", "Gamma valves close pipes.", "Delta engines and pumps.", "Nothing of that kind."]
    chunks = spark.createDataFrame([(i, t, f"n{i}", f"u{i % 3}") for i, t in enumerate(texts)], "item long, text string, name string, url string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.3, 0.95]), (3, [0.7, 0.7]), (4, [-1.0, 0.0])], "item long, v array<double>")
    sentences = spark.createDataFrame([(f"s{i}", i, 0, 5, t) for i, t in enumerate(texts)], "sentence_id string, item long, start int, end int, text string")
    nodes = spark.createDataFrame(
        [("a", 0, "Alpha engine", "machine", ["turbine"], "turns", ["s0", "s9"]), ("b", 1, "Beta pump", "machine", [], "moves water", ["s1"])],
        "id string, seq int, label string, type string, aliases array<string>, summary string, evidence array<string>",
    )
    edges = spark.createDataFrame([("e", 0, "a", "b", "drives", ["s3"])], "id string, seq int, src string, dst string, relation string, evidence array<string>")
    themes = spark.createDataFrame([("c", 0, "Machines", "Engines and pumps", ["a", "b"], ["s3"])], "id string, seq int, title string, summary string, node_ids array<string>, evidence array<string>")
    return Corpus(chunks, vectors, sentences, 3, None, StoredGraph(nodes, edges, themes, 3))


def test_search_calls(spark, library):
    from dataclasses import replace

    from cairn.operators import search_calls as S

    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    status = lambda corpus, q, **more: S.repo_search(corpus, q, [v(1, 0)], 3, **more)[1]["graph_status"]
    assert status(library, ["turbine"]) == "used" and status(library, ["turbine"], graph_assist=False) == "disabled" and status(library, ["turbine"], hybrid=False) == "hybrid_disabled"
    assert status(replace(library, revision=4), ["turbine"]) == "stale_graph" and status(replace(library, stored_graph=None), ["turbine"]) == "no_graph" and status(library, ["zzz"]) == "no_match"
    hits, about = S.repo_search(library, ["turbine drives"], [v(0, 1)], 5)
    assert about == {"graph_status": "used", "graph_rankings": 1, "graph_candidates": 3}
    # the graph ranks 0 (seed, 50), 3 (edge 31 and theme 5), 1 (the edge's other end, 14); the vectors 1, 2, 3, 0, 4
    assert [(r.item, round(r.score, 6)) for r in hits.orderBy("rank").collect()][:3] == [(1, round(1 / 61 + 1 / 63, 6)), (0, round(1 / 64 + 1 / 61, 6)), (3, round(1 / 63 + 1 / 62, 6))]
    only, _ = S.repo_search(library, [], [v(0, 1)], 2)
    assert [r.item for r in only.orderBy("rank").collect()] == [1, 2]
    asked = []
    found, about = S.search_repo(library, "unheard words", lambda q: v(1, 0), 2, expand=lambda q: asked.append(q) or ["engines oil", "Unheard words"], rerank=lambda h: spark.createDataFrame([(4, 0), (77, 1)], "item long, pos int"))
    assert asked == ["unheard words"] and about["confidence"] == "weak" and [r.item for r in found.orderBy("rank").collect()][0] == 4 and found.count() == 2
    S.search_repo(library, "alpha engines oil", lambda q: v(1, 0), 2, expand=lambda q: asked.append(q))
    assert len(asked) == 1
    nodes, edges = S.search_graph(library.stored_graph, library.sentences, "the alpha engine")
    assert [(r.id, [c.sentence_id for c in r.citations]) for r in nodes.collect()] == [("a", ["s0"])]
    assert [(r.src_label, r.relation, r.dst_label, [c["item"] for c in r.citations]) for r in edges.collect()] == [("Alpha engine", "drives", "Beta pump", [3])]
    assert [r.id for r in S.global_search(library.stored_graph, library.sentences, "pumps").collect()] == ["c"] and S.global_search(library.stored_graph, library.sentences, "sailing").count() == 0


def test_recall(spark):
    from cairn.operators import search_calls as S

    rows = [("a", "Likes tea", "green tea", 0.9, 1.0, "active"), ("b", "Works at X", "an office", 0.9, 0.1, "active"), ("c", "Old", "tea", 0.9, 0.1, "superseded"), ("d", "Plays chess", "club", 0.2, 0.1, "stale")]
    nodes = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "id string, label string, summary string, confidence double, durability double, status string, t string")
    nodes = nodes.withColumn("last_confirmed_at", F.col("t").cast("timestamp"))
    edges = spark.createDataFrame([("b", "d", "active"), ("b", "a", "active"), ("d", "c", "superseded")], "src string, dst string, status string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.5, 0.5]), ("d", [-1.0, 0.0])], "item string, v array<double>")
    found = lambda told: {r.id: r["rank"] for r in S.recall(nodes, edges, vectors, "office", F.array(F.lit(0.0), F.lit(1.0)), F.lit("2024-01-02").cast("timestamp"), 1, told=told).collect()}
    assert found(1) == {"b": 1, "d": None} and found(15) == {}


def test_chunks_leave_a_task_in_small_batches(spark):
    """Whatever the batch of texts, few are cut at once."""
    import pyarrow as pa

    texts = [None, "", "x" * 2000, *["a b. " * 300] * 200]
    out = list(chunking._cut([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])]))
    assert len(out) == 4 and max(len(set(b.column(0).to_pylist())) for b in out) <= chunking.CUT_AT_ONCE
    want = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.cut_chunks(t))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_keyword_index(spark, tmp_path):
    from cairn.operators.keyword_index import KeywordIndex

    docs = spark.createDataFrame([(1, "the AB-1234 part"), (2, "the other part. part"), (3, None), (4, "!!"), (5, "AB-1234 the end")], "id long, text string")
    whole = KeywordIndex(spark, str(tmp_path / "a")).build(docs, "id", "text")
    grown = KeywordIndex(spark, str(tmp_path / "b")).build(docs.where("id < 3"), "id", "text").extend(docs.where("id >= 3"), "id", "text")
    plain = retrieval.bm25(docs, "ab-1234 part zzz", "id", "text")
    want = {r.item: round(r.score, 9) for r in plain.collect()}
    assert set(want) == {1, 2, 5}
    for index in (whole, grown):
        assert {r.item: round(r.score, 9) for r in index.search("ab-1234 PART zzz").collect()} == want
        assert index.search("nothing").count() == index.search("").count() == 0
    assert sum(s["n"] for s in grown.segments()) == 5 and len(grown.segments()) == 2
    empty = KeywordIndex(spark, str(tmp_path / "c")).build(docs.limit(0), "id", "text")
    assert empty.search("part").count() == 0


def test_latency_percentiles(spark):
    import random

    rnd = random.Random(3)
    rows = [("hot" if k % 3 else f"k{k % 7}", rnd.choice([None, float(rnd.randint(0, 40)), rnd.random()])) for k in range(3000)]
    got = records.latency_summary(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", (50, 95, 99), percent=True).collect()
    for r in got:
        x = sorted(v for k, v in rows if k == r.k and v is not None)
        assert (r.n, r.min, r.max) == (len(x), x[0], x[-1]) and [r.p50, r.p95, r.p99] == [x[min(int(p * len(x)), len(x) - 1)] for p in (0.5, 0.95, 0.99)]
        assert r.mean == pytest.approx(sum(x) / len(x))


def test_main_content(spark):
    long = "word " * 60
    pages = [
        f"<body><nav>menu</nav><p>intro</p><article><p>{long}</p><nav>inside</nav></article><p>after</p></body>", f"<p>before</p><div class='x post-content'><p>{long}</p>", f"<p>{long}</p><main><p>short</p></main>",
        f"<main><div id=content><p>{long}</p></div><p>more</p></main>", f"<div role=main>{long}</div><article>{long} longer</article>",
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in readers.pages(df).collect()}
    assert got == {0: long.strip(), 1: long.strip(), 2: long.strip() + "\nshort", 3: long.strip() + "\nmore", 4: long + "longer"}


def test_memory_index(spark, tmp_path):
    from cairn.sources.memory_index import MemoryIndex

    repo = Repository(spark, str(tmp_path), "memory")
    index, embed = MemoryIndex(repo), hash_embedding(16)
    nodes = lambda *rows: spark.createDataFrame(list(rows), "id string, label string, summary string")
    find = lambda q, **more: index.search(q, embed(F.lit(q)), 3, **more)
    assert find("tea") is None
    index.upsert(nodes(("a", "Drinks", "green tea"), ("b", "Works", "in an office")), embed, "m1")
    assert find("tea").orderBy("rank").first().id == "a" and find("tea", embed_model="m2") is None
    index.upsert(nodes(("a", "Drinks", "only coffee")), embed, "m1")
    assert repo.documents().count() == 2 and "tea" not in {w for r in repo.chunks().collect() for w in r.text.split()}
    assert find("coffee").orderBy("rank").first().id == "a" and repository.repositories(spark, str(tmp_path)).count() == 0
    index.remove(nodes(("b", "", "")).select("id"))
    assert [r.id for r in find("office").collect()] == ["a"]
    index.rebuild(nodes(("c", "New", "start")), embed, "m2")
    assert [r.id for r in find("start", embed_model="m2").collect()] == ["c"]


def test_jobs(spark, tmp_path):
    from cairn.operators import jobs

    df = spark.createDataFrame([(1, 0, "one"), (1, 1, "two"), (2, 0, "bad"), (2, 1, None), (3, 0, "cut")], "doc_id long, window_idx int, text string")

    def call(text):
        if text == "bad":
            raise ValueError
        return '{"n": [1, 2' if text == "cut" else 'Sure: {"n": %d}' % len(text)

    assert [r.reply for r in jobs.with_calls(df.coalesce(1), "text", call).collect()][2:4] == [None, None]
    done = spark.createDataFrame([], "doc_id long, window_idx int, hash string")
    first = jobs.extract_windows(df, done, call, "n long").cache()
    assert {(r.doc_id, r.window_idx, r.answer.n) for r in first.collect()} == {(1, 0, 3), (1, 1, 3)}
    again = jobs.extract_windows(df.withColumn("text", F.when(F.col("window_idx") == 1, "three").otherwise(F.col("text"))), first, call, "n long")
    assert {(r.doc_id, r.window_idx, r.answer.n) for r in again.collect()} == {(1, 1, 5), (2, 1, 5)}

    def write(rows, name, number):
        path = str(tmp_path / f"{name}-{number}")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "e"), ("c", "a")], "key string, target string")
    handler = jobs.Handler(
        lambda: spark.createDataFrame([("a", 0)], "key string, depth int"),
        lambda items: (items.select("key"), items.join(links, "key").select(F.col("target").alias("key"), (F.col("depth") + 1).alias("depth"))),
        lambda found: found.agg(F.sort_array(F.collect_list("key")).alias("keys")),
    )
    steps = list(jobs.run_job(handler, "key", 2, 10, 2, write))
    assert [(s["findings"], s["pending"]) for s in steps] == [(1, 2), (3, 1), (4, 0), (4, 0)] and steps[-1]["report"].first()["keys"] == ["a", "b", "c", "d"]


def test_entity_graph(spark):
    from cairn.operators import jobs

    said = [("w", "d1", "PER", "Ann", 0, 3), ("w", "d1", "PER", "Bob", 8, 11), ("w", "d1", "ORG", "Acme", 20, 24), ("w", "d1", "PER", "ann", 30, 33), ("v", "d2", "ORG", "Acme", 0, 4), ("v", "d2", "PER", "Ann", 6, 9), ("v", "d2", "X", "Zed", 50, 53)]
    spans = spark.createDataFrame([(*r, 0.9) for r in said], "window_id string, doc_id string, label string, text string, start int, end int, score double")
    sentences = spark.createDataFrame([("w", "w0", 0, 0, 26), ("w", "w1", 1, 27, 60), ("v", "v0", 0, 0, 60)], "window_id string, sentence_id string, sentence_idx int, start int, end int")
    nodes, edges, themes = jobs.entity_graph(spans, sentences, {"PER": "person", "ORG": "company"})
    ids = {r.label.lower(): (r.id, r.type, sorted(r.evidence), sorted(r.doc_ids)) for r in nodes.collect()}
    assert ids["ann"][1:] == ("person", ["v0", "w0", "w1"], ["d1", "d2"]) and ids["zed"][1] == "other" and len(ids) == 4
    names = {v[0]: k for k, v in ids.items()}
    assert {(frozenset((names[r.src], names[r.dst])), r.weight) for r in edges.collect()} == {(frozenset(x), n) for x, n in ((("ann", "bob"), 1), (("ann", "acme"), 2), (("bob", "acme"), 1), (("acme", "zed"), 1), (("ann", "zed"), 1))}
    assert [sorted(names[i] for i in r.node_ids) for r in themes.collect()] == [["acme", "ann", "bob", "zed"]]
    a, b = sorted((ids["bob"][0], ids["ann"][0]))
    nodes, edges, _ = jobs.entity_graph(spans, sentences, {"PER": "person", "ORG": "company"}, spark.createDataFrame([(a, b)], "a string, b string"))
    assert nodes.count() == 3 and edges.count() == 3
    typed, told = jobs.enrich(edges.withColumn("text", F.lit("what")), spark.createDataFrame([("c0", "t"), ("c1", "u")], "community string, text string"), lambda t: f" Says {t} ", spark.createDataFrame([("c1",)], "community string"))
    assert {r.relation for r in typed.collect()} == {"says what"} and [(r.community, r.summary) for r in told.collect()] == [("c1", " Says u ")]


def test_paged_source(spark):
    from cairn.sources.paged import paged

    def fetch(conditions, token, size):
        rows = [(i, f"subject {i % 3}", i * 10) for i in range(137)]
        for column, name, value in conditions:
            if (column, name) == ("received", "ge"):
                rows = [r for r in rows if r[2] >= value]
            else:
                raise ValueError(column)
        at = token or 0
        return rows[at : at + size], at + size if at + size < len(rows) else None

    mail = paged(spark, "mail_test", "id long, subject string, received long", fetch, [("received", "ge")], 50, 130)
    assert mail.count() == 130
    some = mail.where("received >= 1000 and subject = 'subject 1'")
    assert sorted(r.id for r in some.collect()) == [i for i in range(100, 137) if i % 3 == 1]


def test_sorting_cells(spark):
    from cairn.operators import filters

    df = spark.createDataFrame([(i, x) for i, x in enumerate(["10", "9 apples", "b", "A", None, "-1.5e1", "x1"])], "i int, x string")
    assert [r.i for r in filters.sorted_by_cell(df, "x", "asc", "i").collect()] == [5, 1, 0, 4, 3, 2, 6]
    assert [r.i for r in filters.sorted_by_cell(df, "x", "desc", "i").collect()] == [6, 2, 3, 4, 0, 1, 5]
    assert filters.sorted_by_cell(df, "x", None).count() == 7


def test_buckets(spark):
    """Near-duplicates meet in buckets, few other pairs do."""
    import numpy as np

    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((20, 64))
    rows = [c + rnd.standard_normal(64) * 0.1 for c in centres for _ in range(6)] + list(rnd.standard_normal((800, 64)))
    u = np.array([r / np.linalg.norm(r) for r in rows])
    near = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j}
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")
    bits = V.recommended_bits(len(rows))
    met = {(r.a, r.b) for r in graph.lsh_candidates(df, bits, 64).collect()}
    assert len(near & met) >= 0.95 * len(near) and len(met) < 0.1 * len(rows) * (len(rows) - 1) / 2
    assert {(r.a, r.b) for r in graph.similar_pairs(df, graph.lsh_candidates(df, bits, 64), 0.9).collect()} == near & met
