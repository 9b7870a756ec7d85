"""Shuffle files of written tables, blocks of vectors and sets, postings."""

from __future__ import annotations

import os

import numpy as np

from cairn.llm.scratch import Scratch
from cairn.operators import graph, memory
from cairn.session import Tables, swept
from cairn.sources.commits import Commits


def _shuffled(spark) -> set[str]:
    """Names of the shuffle files that are there."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "id % 5003 as k")
    df = df.join(df.groupBy("k").count().hint("merge"), "k")
    writes = {
        "scratch": lambda: Scratch(spark, "t").table(df, "x"),
        "tables": lambda: Tables(spark, "t").keep(df),
        "commits": lambda: Commits(spark, f"file://{tmp_path}/c").commit({"x": df}),
    }
    for name, write in writes.items():
        before = _shuffled(spark)
        write()
        assert not _shuffled(spark) - before, name
    assert spark.read.parquet(f"{tmp_path}/c/x").count() == df.count() == 20_000


def test_sweeping_is_for_what_is_inside(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with swept(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_nearest_in_rounds_ship_no_copies_of_vectors(spark, monkeypatch):
    """Equal to brute force with ties, whatever is held at once; vectors are not dealt to pairs of blocks."""
    rnd = np.random.default_rng(5)
    v = rnd.integers(-2, 3, size=(90, 6)) + 0.5
    v[40:60] = v[3]
    rows = [(int(i) * 7, x.tolist()) for i, x in enumerate(v)]
    u = v / np.sqrt(sum(v[:, d] * v[:, d] for d in range(6)))[:, None]
    cosine = sum(u[:, None, d] * u[None, :, d] for d in range(6))
    want = set()
    for i in range(90):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-cosine[i, j], j))[:5]
        want |= {(i * 7, j * 7, r + 1) for r, j in enumerate(order)}
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for held, block in ((1 << 24, 2048), (1500, 16), (400, 3)):
        monkeypatch.setattr(graph, "HELD", held, raising=False)
        got = graph.knn_blocked(df, 5, block)
        assert "CoGroups" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.neighbour, r["rank"]) for r in got.collect()} == want
    assert [r["rank"] for r in graph.knn_blocked(df.limit(2)).collect()] == [1, 1]
    assert not graph.knn_blocked(df.limit(0)).collect()


def test_pairs_of_equal_sets_come_in_order(spark):
    """What pairs of a part make is runs and repeated sequences, which Parquet writes small."""
    n = 100
    nodes = spark.range(n).selectExpr("id * 7919 % 1009 as id", "'k' as kind", "'same words here' as label", "'' as summary", "'active' as status")
    got = [(r.a, r.b) for r in memory.similar(nodes).collect()]
    ids = sorted(i * 7919 % 1009 for i in range(n))
    assert got == [(a, b) for a in ids for b in ids if a < b]
