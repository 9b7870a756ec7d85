"""Commits over several tables: logs that stay short, pins, clean-up, rollups, conversations, cached corpora."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators.records import audit_rollup
from cairn.sources import audit, commits, files, repository
from cairn.sources.audit import AuditLog
from cairn.sources.commits import Commits, RevisionConflict
from cairn.sources.repository import CorpusCache, Repository, hash_embedding
from cairn.sources.threads import Threads
from cairn.streaming import streams


def test_log_stays_short(spark, tmp_path, monkeypatch):
    """Reading the log takes as many files after 95 commits as after 15, and the entries are all there."""
    c = Commits(spark, str(tmp_path / "c"))
    real, opened = files.read, []
    monkeypatch.setattr(files, "read", lambda *a: opened.append(a[1]) or real(*a))

    def reads():
        opened.clear()
        log = c.log()
        return len(opened), log

    row = spark.range(1)
    for _ in range(3):
        c.commit({"t": row})
    for _ in range(12):
        c.commit({}, marks=["t"])
    early, _ = reads()
    for _ in range(80):
        c.commit({}, marks=["t"])
    late, log = reads()
    assert early == late <= commits.EVERY + 1 and [e["revision"] for e in log] == list(range(1, 96))
    assert len(files.listed(spark, f"{c.home}/log")) <= 2 * commits.EVERY and len(files.listed(spark, f"{c.home}/gathered")) <= 2
    assert c.read("t").count() == 3
    c.commit({"t": row}, replaces=["t"])
    assert [e["revision"] for e in c.log()] == [96] and c.read("t").count() == 1
    with pytest.raises(RevisionConflict):
        c.commit({}, expected=95)


def test_vacuum_spares_pins(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "c"))
    c.commit({"t": spark.range(3)})
    c.commit({"t": spark.range(3, 5)})
    old = c.read("t")
    pin = c.pin()
    spark.range(7).write.parquet(f"{c.home}/t/revision=3/attempt=lost")  # of a commit that died
    c.commit({"t": spark.range(9)}, replaces=["t"])
    assert c.vacuum() == 1 and old.count() == 5 and c.read("t").count() == 9
    c.unpin(pin)
    spark.range(7).write.parquet(f"{c.home}/t/revision=4/attempt=underway")
    assert c.vacuum() == 2 and c.read("t").count() == 9 and files.exists(spark, f"{c.home}/t/revision=4/attempt=underway")


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, name string, url string, text string")


def test_repository_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "COMPACTED", 3)
    repo, embed = Repository(spark, str(tmp_path), "r"), hash_embedding(8)
    for i in range(4):
        repo.add(_docs(spark, (i, f"n{i}", "u", f"alpha number{i}. Beta!"), (9, "n", "u", f"alpha again {i}")), embed, embed_model="hash", kind="notes")
    repo.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert len(repo.log()) <= 3 and repo.meta() == {"embed_model": "hash", "kind": "notes"}
    plain = Repository(spark, str(tmp_path), "plain")
    plain.add(_docs(spark, *[(i, f"n{i}", "u", f"alpha number{i}. Beta!") for i in (0, 2, 3)], (9, "n", "u", "alpha again 3")), embed)
    both = [sorted((r.doc_id, r.chunk_id, r.text) for r in x.chunks().collect()) for x in (repo, plain)]
    assert both[0] == both[1] and repo.documents().count() == 4 and repo.sentences().count() == plain.sentences().count()
    scored = [{r.item: round(r.score, 9) for r in x.lexical("alpha number2").collect()} for x in (repo, plain)]
    assert scored[0] == scored[1]
    assert repo.vacuum() > 0 and repo.search("alpha", embed(F.lit("alpha")), 3).count() == 3
    repo.delete(spark.createDataFrame([(i,) for i in (0, 2, 3, 9)], "doc_id long"))
    assert repo.scales() is None
    repo.compact()
    assert repo.scales() is None and repo.documents().count() == 0
    repo.add(_docs(spark, (5, "n", "u", "gamma")), embed)
    assert repo.scales() is not None and repo.chunks().count() == 1 and repo.meta()["kind"] == "notes"


def test_corpus_cache(spark, tmp_path):
    """A second search of a revision reads no file, a commit makes a new snapshot, a fourth corpus puts the oldest out."""
    embed = hash_embedding(8)
    repos = [Repository(spark, str(tmp_path), f"r{i}") for i in range(4)]
    for i, r in enumerate(repos):
        r.add(_docs(spark, (i, "n", "u", f"alpha word{i}")), embed)
    cache = CorpusCache()
    search = lambda x: [(r.chunk_id, round(r.score, 9)) for r in x.search("alpha", embed(F.lit("alpha")), 3).collect()]
    first = cache.get(repos[0])
    want = search(first)
    for t in ("docs", "chunks", "vectors", "postings", "scales"):
        files.delete(spark, f"{first.home}/{t}")
    assert cache.get(repos[0]) is first and search(first) == want == [("0:c0", want[0][1])]
    second = cache.get(repos[1])
    search(second)
    repos[1].add(_docs(spark, (7, "n", "u", "alpha beta")), embed)
    assert {c for c, _ in search(second)} == {"1:c0"}  # as it was
    again = cache.get(repos[1])
    assert again is not second and {c for c, _ in search(again)} == {"1:c0", "7:c0"} and not second._held
    cache.get(repos[2]), cache.get(repos[3])
    assert first.home not in cache._held and len(cache._held) == 3 and not first._held
    assert len(files.listed(spark, f"{repos[0].home}/pins")) == 0 and len(files.listed(spark, f"{repos[3].home}/pins")) == 1
    with pytest.raises(RevisionConflict):
        again.commit({})
    cache.close()


def test_rollup_kept_as_it_grows(spark, tmp_path, monkeypatch):
    """Any order of appends, deletions and merges gives the rollup of the events that are left."""
    monkeypatch.setattr(audit, "MERGED", 3)
    rnd = random.Random(4)
    log, held = AuditLog(spark, str(tmp_path / "a"), "conv", "ts", "body"), []
    assert log.rollup() is None
    for step in range(9):
        if step in (3, 6):
            gone = {f"c{rnd.randrange(4)}" for _ in range(2)}
            log.delete(spark.createDataFrame([(c,) for c in gone], "conv string"))
            held = [e for e in held if e[0] not in gone]
        else:
            new = [(f"c{rnd.randrange(4)}", datetime(2026, 1, 1, rnd.randrange(24), step), "ü" * rnd.randrange(5)) for _ in range(6)]
            log.append(spark.createDataFrame(new, "conv string, ts timestamp, body string"))
            held += new
        if step == 7:
            log.compact()
            log.vacuum()
        want = audit_rollup(spark.createDataFrame(held, "conv string, ts timestamp, body string"), "conv", "ts", "body")
        assert sorted(map(tuple, log.rollup().select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sum("sums" in e["tables"] for e in log.log()) <= 4 and log.events().count() == len(held)
    last = [r.last_ts for r in log.index().collect()]
    assert last == sorted(last, reverse=True)


def test_threads(spark, tmp_path, monkeypatch):
    store = Threads(spark, str(tmp_path / "t"))
    assert store.entries().count() == store.messages().count() == 0
    entries = spark.createDataFrame([("a", "A", datetime(2026, 1, 1, 0, 0, 0, 123456), 2), ("b", "B", None, 1), ("x", "no body", None, 0), (None, "n", None, 1)], "id string, title string, updated_at timestamp, message_count long")
    messages = spark.createDataFrame([("a", 0, "user", "hi"), ("a", 1, "assistant", "ho"), ("b", 0, "user", "q\n\"x\""), ("z", 0, "user", "no entry"), (None, 0, "u", "t")], "id string, seq long, role string, text string")
    labels = spark.createDataFrame([("a", ["l1", "l1", "l2"]), ("x", ["l1"])], "id string, labels array<string>")
    store.save(entries, messages, 0, labels, spark.createDataFrame([("l1", "red"), ("l2", None)], "label string, color string"))
    shown = lambda s: sorted((r.id, r.title, r.updated_at, tuple(r.labels)) for r in s.entries().collect())
    said = lambda s: sorted((r.id, r.seq, r.text) for r in s.messages().collect())
    first = [("a", "A", datetime(2026, 1, 1, 0, 0, 0, 123456), ("l1", "l2")), ("b", "B", None, ())]
    assert shown(store) == first and said(store) == [("a", 0, "hi"), ("a", 1, "ho"), ("b", 0, 'q\n"x"')]
    # saved again: labels stay, messages are the new ones
    store.save(entries.where("id = 'a'").withColumn("title", F.lit("A2")), messages.where("id = 'a' and seq = 0"))
    assert shown(store)[0][1::2] == ("A2", ("l1", "l2")) and said(store) == [("a", 0, "hi"), ("b", 0, 'q\n"x"')]
    store.relabel(spark.createDataFrame([("a", []), ("b", ["l2"]), ("none", ["l1"])], "id string, labels array<string>"))
    assert [x[3] for x in shown(store)] == [(), ("l2",)]
    store.export(f"file://{tmp_path}/out")
    copy = Threads(spark, str(tmp_path / "copy"))
    copy.save(entries.where("id = 'b'").withColumn("title", F.lit("old")), messages.where("id = 'b'"))
    before = shown(copy), said(copy)
    monkeypatch.setattr(files, "create", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        copy.import_(f"file://{tmp_path}/out")
    monkeypatch.undo()
    assert (shown(copy), said(copy)) == before and copy.revision() == 1  # a killed import changes nothing
    copy.import_(f"file://{tmp_path}/out", 1)
    assert shown(copy) == shown(store) and said(copy) == said(store) and {r.label for r in copy.registry().collect()} == {"l1", "l2"}
    copy.delete(spark.createDataFrame([("b",), ("none",)], "id string"))
    assert [x[0] for x in shown(copy)] == ["a"] and said(copy) == [("a", 0, "hi")]
    copy.save(entries.where("id = 'b'"), messages.where("id = 'b'"))
    assert [(x[0], x[3]) for x in shown(copy)] == [("a", ()), ("b", ())]  # what comes back has lost its labels
    held = shown(copy), said(copy)
    copy.compact()
    copy.vacuum()
    assert (shown(copy), said(copy)) == held and len(copy.log()) == 1
    store.export(f"file://{tmp_path}/one", spark.createDataFrame([("b",)], "id string"))
    assert spark.read.json(f"{tmp_path}/one/entries").count() == 1


def test_changes_read_few_epochs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "SNAPSHOTS", 4)
    target = f"file://{tmp_path}/changes"
    merge, state = streams.apply_changes(target, "k", ["v"]), {}
    for epoch in range(11):
        rows = [(epoch % 3, epoch, False), (5 + epoch, 1, False), (4 + epoch, 1, True)]
        for k, v, gone in rows:
            state[k] = v
            if gone:
                state.pop(k)
        df = spark.createDataFrame(rows, "k long, v long, removed boolean")
        merge(df, epoch)
        if epoch in (3, 7):
            merge(df, epoch)  # repeated
        assert {r.k: r.v for r in streams.changed_state(spark, target, "k").collect()} == state
    for old in range(8):
        files.delete(spark, f"{target}/epoch={old}")  # below the last whole state
    assert {r.k: r.v for r in streams.changed_state(spark, target, "k").collect()} == state


def test_repository_shuffles_what_may_be_dead(spark, tmp_path):
    """Stored rows are not shuffled to find that they are live, and postings lie in tasks by their texts' size, not in a task for each bucket."""
    repo, embed = Repository(spark, str(tmp_path), "r"), hash_embedding(8)
    repo.add(_docs(spark, *[(i, "n", "u", f"alpha number{i}. Beta!") for i in range(40)]), embed)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan(repo.chunks()) and repo.chunks().count() == 40
    # a document that is given twice, once without a text, is rejected: what it had before stays
    repo.add(_docs(spark, (1, "n", "u", "gamma"), (1, "n", "u", " "), (2, "n", "u", "delta")), embed)
    repo.delete(spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long"))
    want = sorted([(i, f"alpha number{i}. Beta!") for i in range(20) if i != 2] + [(2, "delta")])
    for _ in range(2):
        assert sorted((r.doc_id, r.text) for r in repo.chunks().collect()) == want
        repo.compact()
    assert "Join" not in plan(repo._live("postings")) and repo.sentences().count() == 39
    assert sorted(r.item for r in repo.lexical("alpha gamma number30").collect()) == sorted(f"{i}:c0" for i in range(20) if i != 2)
