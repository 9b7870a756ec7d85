"""Joins of the link steps stay off the driver, and Golay links decide on near copies."""

from __future__ import annotations

import random

import pyarrow as pa

from cairn.llm import near_copies, simhash
from cairn.llm.components import components
from cairn.llm.scratch import Scratch


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(spark):
    fps = spark.range(100).selectExpr("id as fp", "id as comp")
    homes, probes = (fps.mapInArrow(simhash._keys(k), "key long, fp long, comp long") for k in (True, False))
    plan = _plan(simhash._pairs(homes, probes, ["key"]))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rounds_of_components_are_not_broadcast(spark, monkeypatch):
    plans = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: plans.append(_plan(df)) or table(self, df, name))
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    got = {tuple(r) for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def _families(n: int, words: int, edits: int) -> list[tuple[int, str]]:
    rnd = random.Random(3)
    out = []
    for f in range(n):
        said = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(4):
            out.append((len(out), " ".join(said)))
            for _ in range(edits):
                said[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
    return out


def _brute(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [set(x.tobytes() for x in near_copies.shingle_sets(pa.array([t]))[0]) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return dict(enumerate(root))


def _classes(spark, rows):
    return {r.doc_id: r.component_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}


def test_golay_links_decide_on_pairs_within_three_bits(spark, monkeypatch):
    rows = _families(12, 400, 1)
    want = _brute(rows)
    assert _classes(spark, rows) == want
    monkeypatch.setattr(near_copies, "link", lambda fps, scratch: fps.selectExpr("fp as node", "fp as root").limit(0))
    assert _classes(spark, rows) != want


def test_classes_of_fingerprints_are_met_within(spark, monkeypatch):
    rows = _families(6, 100, 3)  # the ends of a chain are not similar, so its centre does not link all of it
    want = _brute(rows)
    assert len(set(want.values())) < len(rows)
    monkeypatch.setattr(near_copies, "link", lambda fps, scratch: fps.selectExpr("fp as node", "0L as root"))
    monkeypatch.setattr(near_copies, "DISTANCE", 64)
    assert _classes(spark, rows) == want


def test_keys_of_near_copies_are_not_broadcast(spark):
    nodes = spark.range(50).selectExpr("id as node", "5 as size", "array(id, id + 1) as keys", "id as comp")
    met = near_copies._shared_keys(nodes).join(nodes.select("node", "comp").hint("merge"), "node")
    assert "Broadcast" not in _plan(near_copies._pairs(met, met, ["key"], 0.8))


def test_tables_go_when_they_are_read(spark, monkeypatch):
    """Keys, shingles and texts of pairs are not on disk any more when the rows that stay are written."""
    left = []
    table, drop = Scratch.table, Scratch.drop
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: left.append((out := table(self, df, name)).cairn_path) or out)
    monkeypatch.setattr(Scratch, "drop", lambda self, *ts: [left.remove(t.cairn_path) for t in ts] and drop(self, *ts))
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:39], "other"]), "something else altogether", " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.representatives(docs, Scratch(spark, "t")).collect()) == [0, 2]
    names = {p.rsplit("-", 1)[-1] for p in left}
    assert "sets" in names and not names & {"nodes", "met", "groups", "texts", "pairs", "uses", "home", "labelled", "dense"}


def test_keys_of_one_node_are_not_joined(spark):
    """Keys that one node holds are kept from the join by a table of bits; those of several all come, with their places."""
    rows = [(i, 3, [7 if i < 3 else 1000 + i, 2000 + i, 3000 + i // 2]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node long, size int, keys array<long>")
    met = near_copies._shared_keys(nodes, Scratch(spark, "keys"))
    want = [(i, 3, 0, 7, 3) for i in range(3)] + [(i, 3, 2, 3000 + i // 2, 2) for i in range(40)]
    assert sorted((r.node, r.size, r.place, r.key, r.n) for r in met.collect()) == sorted(want)
    assert "getbit" in met._jdf.queryExecution().analyzed().toString()
