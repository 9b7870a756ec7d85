"""References in pages, pairs of buckets, classes of equal term sets."""

from __future__ import annotations

import numpy as np
import pandas as pd

from cairn.operators import graph
from cairn.sources import readers


def test_references_without_a_semicolon(spark):
    html = '<title>a&amp;&amp</title><body><h1>a&amp;&amp</h1><p>x &lt y &#39; z</p><a href="http://e.org/?a=1&b=2">t</a></body>'
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    kept = readers.pages(df, unclosed=False).first()
    assert (kept.title, kept.text, kept.links[0].href) == ("a&&amp", "a&&amp\nx &lt y ' z\nt", "http://e.org/?a=1&b=2")
    assert readers.pages(df).first().title == "a&&"


def test_pairs_of_buckets_need_no_candidates(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(150)]
    v = spark.createDataFrame([*rows, (150, rows[3][1]), (151, rows[3][1])], "id long, v array<double>")
    want = {(r.a, r.b): r.cosine for r in graph.similar_pairs(v, graph.lsh_candidates(v, 3, 8), 0.3).collect()}
    for block in (1024, 7):  # whole buckets, and parts of them
        rows = graph.bucketed_pairs(v, 3, 8, 0.3, block).collect()
        got = {(r.a, r.b): r.cosine for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_with_ties():
    u = [[1.0, 0.0]] * 5 + [[0.6, 0.8]] * 4 + [[float("nan"), 0.0]]
    f = pd.DataFrame({"id": list(range(10)), "u": u})
    got = graph._nearest(3)(f, f)
    assert got[got.id == 4].neighbour.tolist() == [0, 1, 2] and got[got.id == 5].neighbour.tolist() == [6, 7, 8]
    assert not len(got[got.id == 9])
