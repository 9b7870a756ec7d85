import pytest
from pyspark.sql import functions as F

from cairn.operators import assist


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ranking(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "item string, rank int")
    order = spark.createDataFrame([("c", 1), ("x", 2), ("c", 3)], "item string, pos int")
    assert [(r.item, r.new_rank) for r in assist.rerank(hits, order, 2).orderBy("new_rank").collect()] == [("c", 1), ("a", 2)]
    m = spark.createDataFrame([("Mail",), ("my mail",), ("email",), ("mailbox",), ("x",)], "label string").withColumn("pos", F.monotonically_increasing_id())
    assert [r.label for r in assist.mention_rank(m, "mail", "label", "pos").collect()] == ["Mail", "mailbox", "my mail", "email"]


def test_text(spark):
    df = spark.createDataFrame([(1, "a [[x, y]] b [[z]] [[x;x]]"), (2, None)], "key int, text string")
    known = spark.createDataFrame([("x",)], "id string")
    assert rows(assist.clean_citations(df, "text", known)) == [(1, "a [[x]] b  [[x]]"), (2, None)]
    t = spark.createDataFrame([('{"a": [1, 2',), ('{"a": "}"}',), ('"open',), (None,)], "t string")
    assert [r.x for r in t.select(assist.looks_truncated(F.col("t")).alias("x")).collect()] == [True, False, True, False]
    w = spark.createDataFrame([(1, "a\nb\nc"), (2, "x")], "id int, text string")
    assert rows(assist.split_window(w, "text")) == [(1, 0, "a\nb"), (1, 1, "c"), (2, 0, "x")]
    s = spark.createDataFrame([("/Sum it up",), ("no",)], "t string").select(assist.slash_command(F.col("t")).alias("c")).collect()
    assert (s[0].c.command, s[0].c.rest, s[1].c) == ("sum", "it up", None)
    e = spark.createDataFrame([("event: x\ndata: {1}\ndata: {2}",), ("{3}",)], "t string").select(assist.event_stream(F.col("t")).alias("d")).collect()
    assert [r.d for r in e] == [["{1}", "{2}"], ["{3}"]]


def test_windows(spark):
    i = spark.createDataFrame([(1, k, 0.1 if k in (0, 1, 2) else 0.9) for k in range(5)], "doc_id int, window_idx int, information double")
    assert [r.skipped for r in assist.low_information(i).orderBy("window_idx").collect()] == [False, True, True, False, False]
    b = spark.createDataFrame([(1, 5), (2, 4), (3, 9), (4, 1)], "k int, n int")
    assert [r.k for r in assist.budget_prefix(b, ["k"], F.col("n"), 10).collect()] == [1, 2]
    m = spark.createDataFrame([(1, k, "tool" if k % 2 else "user", "x" * 100 if k != 5 else "[summary] " + "x" * 90) for k in range(10)], "conv_id int, seq int, role string, text string")
    gone = lambda budget: [r.seq for r in assist.compaction(m, budget, 2).where("evicted").orderBy("seq").collect()]
    assert (gone(1000), gone(999), gone(948), gone(947), gone(946), gone(0)) == ([], [1], [1], [1], [1, 3], [1, 3, 7])
    image = m.withColumn("image", F.col("seq") == 2)
    assert [r.seq for r in assist.compaction(image, 0, 2).where("evicted").orderBy("seq").collect()] == [1, 2, 3, 7]
    c = assist.coverage(spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, window_idx int"), spark.createDataFrame([(1, 1)], "doc_id int, window_idx int"))
    assert rows(c) == [(1, 3, 1, [0, 2])]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, "r"), (2, 3, "s"), (4, 5, "r")], "src int, dst int, relation string")
    assert [(r.src, r.dst) for r in assist.edges_to_type(e, 1).collect()] == [(1, 2)]
    mem = spark.createDataFrame([("c", 1, "A"), ("c", 2, "B"), ("c", 3, "C")], "community string, id int, label string")
    assert assist.community_summary(mem, e).first().summary == "B, A, C: A r B; B s C"
    t = spark.createDataFrame([("a", [1, 2]), ("b", [2, 2]), ("c", [9])], "id string, doc_ids array<int>")
    assert rows(assist.shared_documents(t)) == [("a", "b", 1)]
    ch = spark.createDataFrame([(i, i // 2, f"word{i // 3} common") for i in range(6)], "id long, doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.9), (3, 4, 0.9), (4, 5, 0.9), (3, 5, 0.9)], "a long, b long, cosine double")
    topics, links = assist.topic_graph(ch, pairs, ["common"])
    assert [(r.id, r.keywords) for r in topics.orderBy("id").collect()] == [("com0", ["word0"]), ("com1", ["word1"])]
    assert rows(links) == [("com0", "com1", 1)]
    com = spark.createDataFrame([("x", 0, "alpha", "", [1]), ("y", 1, "beta", "gamma", [2]), ("z", 2, "delta", "", [3, 4])], "id string, seq int, title string, summary string, node_ids array<int>")
    nodes = spark.createDataFrame([(1, "gamma ray", ["g"], "", "a"), (2, "q", [], "", "a"), (3, "r", ["gamma"], "", "a"), (4, "s", [], "", "a")], "id int, label string, aliases array<string>, summary string, type string")
    links = spark.createDataFrame([(3, 4, "emits gamma"), (1, 2, "gamma")], "src int, dst int, relation string")
    ranked = lambda q, *more: [(r.id, r.score) for r in assist.community_rank(com, q, 5, *more).collect()]
    assert ranked("the gamma") == [("y", 1)] and ranked("main themes of the whole") == [("x", 0), ("y", 0), ("z", 0)]
    assert ranked("the gamma", nodes, links) == [("z", 4), ("x", 3), ("y", 1)] and ranked("none of it here") == []


def test_records(spark):
    b = spark.createDataFrame([("http://X", "", ["a"], 2), ("http://x", "T", ["b", "a"], 1)], "url string, title string, tags array<string>, pos int")
    assert rows(assist.merge_bookmarks(b)) == [("http://x", "http://x", "T", ["b", "a"], 1)]
    c = spark.createDataFrame([(1, [("k", "v"), ("k", "w")])], "id int, cells array<struct<key:string,value:string>>")
    assert rows(assist.pivot_cells(c, "cells", ["k", "z"])) == [(1, "v", None)]
    f = spark.createDataFrame([("x", ["http://a", "ftp://b"]), (" ", ["http://c"]), ("y", ["http://a"])], "text string, sources array<string>")
    assert rows(assist.research_reduce(f)) == [(2, ["http://a"])]
    d = spark.createDataFrame([(1, "t"), (2, "u")], "doc_id int, text string")
    s = d.select("doc_id", F.sha2(F.lit("t"), 256).alias("hash"))
    assert [r.doc_id for r in assist.reset_changed(s, d, "text").collect()] == [1]
    one, rest = assist.take_batch(d, 1, ["doc_id"])
    assert (one.count(), rest.count()) == (1, 1)
    t = spark.createDataFrame([("09:30",), ("9:30",)], "t string").select(assist.local_time(F.col("t")).alias("x")).collect()
    assert (t[0].x.hour, t[0].x.minute, t[1].x) == (9, 30, None)


def test_small(spark):
    w = spark.createDataFrame([(1, 0, "Menu\nalpha"), (1, 1, "menu \nbeta"), (2, 0, "menu")], "doc_id int, window_idx int, text string")
    assert [(r.doc_id, r.window_idx, r.repeats) for r in assist.repeated_lines(w, "text").orderBy("doc_id", "window_idx").collect()] == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]
    e = spark.createDataFrame([("c", 1, 2, "knows"), ("c", 2, 9, "has")], "g string, src int, dst int, relation string")
    n = spark.createDataFrame([(1, "A"), (2, "B")], "id int, label string")
    assert assist.render_edges(e, n, ["g"]).first().text == "A -[knows]-> B\nB -[has]-> ?"
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    r = spark.range(1).select(
        assist.next_after_run(F.lit(False), F.lit("2024-01-02").cast("timestamp"), now).alias("a"), assist.next_after_run(F.lit(True), now, now).alias("b"),
        assist.lesson_score(F.lit("open the settings page"), F.array(F.lit("Settings"), F.lit(""), F.lit("page of x")), F.lit("ex.org"), F.lit("a.ex.org")).alias("c"),
        assist.first_incompatibility(F.lit("needs bash"), [("python", "p"), ("bash", "shell")]).alias("d"),
        assist.one_of(F.lit("pink"), ["red"], "grey").alias("e"), assist.map_label(F.lit("PER"), {"PER": "person"}, "other").alias("f"),
        assist.within_limits(F.lit("2024-01-01 09:00:00").cast("timestamp"), now, F.lit(60), F.lit(9), F.lit(5)).alias("g"),
    ).first()
    assert (r.a.enabled, r.b.enabled, r.b.next, r.c, r.d, r.e, r.f, r.g) == (True, False, None, 7, "shell", "grey", "person", "time")


def test_topics_share_documents_without_gathering(spark, tmp_path):
    from cairn.plans import queries

    rows = [(1, 7, 1), (1, 8, 1), (1, 7, 2), (2, 7, 1), (2, 8, 2), (3, 9, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.topics_sharing_documents(spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [(7, 8, 2)]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_dealt_by_their_number(spark, monkeypatch):
    from cairn import session

    monkeypatch.setattr(session, "DEALT", 50)
    rows = session.dealt(spark.range(5000), "id")
    assert rows.count() == 5000 and rows.rdd.getNumPartitions() == max(100, spark.sparkContext.defaultParallelism)
    assert session.dealt(spark.range(0), "id").count() == 0


def test_topics_see_a_pair_once(spark, monkeypatch):
    """Two neighbours whose cosines differ in the last bit are one pair."""
    from cairn.plans import queries

    given = []
    rows = spark.createDataFrame([(1, [1.0], "s", "t")], "vec_id long, embedding array<double>, source string, text string").withColumn("doc_id", F.col("vec_id"))
    none = spark.createDataFrame([], "id string, size long, keywords array<string>")
    near = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5 + 2**-53), (1, 3, 0.25)], "id long, neighbour long, cosine double")
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    monkeypatch.setattr(queries.graph, "knn_bucketed", lambda *_: near)
    monkeypatch.setattr(queries.assist, "topic_graph", lambda docs, pairs: given.append(pairs) or (none, none))
    queries.topic_graph(spark, "")
    assert sorted((r.a, r.b) for r in given[0].collect()) == [(1, 2), (1, 3)]


def test_window_of_many_names(spark):
    """A line of 50,000 capitalised words is one name, whatever the depth of the stack; names do not go on over lines."""
    text = "Ab " * 50_000 + "x\nNew York-\nThe Hague&. and\nxAb Cd\n" + "É Old Town"
    rows = spark.createDataFrame([(1, 0, text), (1, 1, "\n \n"), (1, 2, "Aa Bb. Cc dd Ee Ff\nAa Bb. Cc dd Ee Ff")], "doc_id long, window_idx int, text string")
    got = {r.window_idx: r.information for r in assist.window_information(rows, "text").collect()}
    # five lines, 50,010 words, a name in each but the fourth; no signs of tables but two dots
    assert got[0] == pytest.approx(0.35 + 0.2 * 4 / 5 + 0.2 * (1 - 4 * 1 / (150_001 + 9 + 15 + 6 + 10)) + 0.03 + 0.15)
    assert got[1] == 0.0 and got[2] == pytest.approx(0.35 * 6 / 8 + 0.2 + 0.2 * (1 - 4 * 2 / 36) + 0.03 + 0.15 * 0.5)
