"""Label propagation in place and greedy merging, whose results follow the order of ids, over graphs of any size.

Both are defined as one pass in order of ids, in which a node sees what the nodes before it have become. Small components
are folded in a task of their own. In others all nodes are computed at once from a guess, and again those whose earlier
neighbours came out otherwise than guessed, until none does: what is left then is the result of the pass in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables

#: Links of a component that one task may hold.
FOLDED = 100_000


def fold_labels(links: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """id, label of one group of links (a, b)."""
    near: dict = {}
    for a, b in links[["a", "b"]].itertuples(index=False):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {x: x for x in near}
    order = sorted(near)
    for _ in range(rounds):
        moved = False
        for x in order:
            votes: dict = {}
            for y in near[x]:
                votes[label[y]] = votes.get(label[y], 0) + 1
            best = min(votes, key=lambda v: (-votes[v], v))
            moved, label[x] = moved or best != label[x], best
        if not moved:
            break
    return pd.DataFrame({"id": list(label), "label": list(label.values())}, dtype=object)


def label_waves(links: DataFrame, rounds: int) -> DataFrame:
    """id, label of distinct links a < b, in grouped aggregations only.

    In a round a node's label follows from the new labels of its smaller neighbours and the old ones of the others. A
    round begins with the old labels as a guess at the new ones, and computes the nodes that have a larger neighbour which
    moved in the round before. Whenever a node comes out otherwise than guessed, its larger neighbours are computed again.
    The number of passes over the links is that of the longest run of such corrections, not that of the nodes.
    """
    tables = Tables(links.sparkSession, "labels")
    near = tables.keep(links.select(F.col("a").alias("id"), F.col("b").alias("nb")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("nb"))))
    state = tables.keep(near.select("id").distinct().select("id", F.col("id").alias("old"), F.col("id").alias("new"), F.lit(True).alias("moved")))
    for number in range(rounds):
        first = True
        while True:
            seen = state.select(F.col("id").alias("nb"), "old", "new", "moved")
            votes = near.join(seen, "nb")
            smaller = F.col("nb") < F.col("id")
            if number or not first:  # moved: in the round before, or in this round's pass before
                due = votes.where(F.col("moved") & (smaller if not first else ~smaller)).select("id").distinct()
                votes = votes.join(due, "id", "left_semi")
            votes = votes.groupBy("id", F.when(smaller, F.col("new")).otherwise(F.col("old")).alias("label")).agg(F.count("*").alias("n"))
            best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("best"))
            label = F.coalesce("best", "new")
            after = state.join(best, "id", "left").select("id", "old", label.alias("new"), (label != F.col("new")).alias("moved"))
            state, first = tables.keep(after, state), False
            if state.where("moved").isEmpty():
                break
        if state.where("new <> old").isEmpty():
            break
        state = tables.keep(state.select("id", F.col("new").alias("old"), "new", (F.col("new") != F.col("old")).alias("moved")), state)
    tables.drop(near)
    return state.select("id", F.col("new").alias("label"))


def in_place_labels(links: DataFrame, roots: DataFrame, rounds: int, folded: int = FOLDED) -> DataFrame:
    """id, label: components (roots: id, root) of up to ``folded`` links each in a task, the others by waves."""
    kind = links.schema["a"].dataType.simpleString()
    tables = Tables(links.sparkSession, "components")
    rooted = tables.keep(links.join(roots.withColumnRenamed("id", "a").hint("shuffle_merge"), "a").select("a", "b", "root"))
    large = tables.keep(rooted.groupBy("root").count().where(F.col("count") > folded).select("root"))
    none = large.isEmpty()
    small = rooted if none else rooted.join(large, "root", "left_anti")
    out = small.groupBy("root").applyInPandas(lambda g: fold_labels(g, rounds), f"id {kind}, label {kind}")
    return out if none else out.unionByName(label_waves(rooted.join(large, "root", "left_semi").select("a", "b"), rounds))


def merged_in_order(links: DataFrame) -> DataFrame:
    """id, into for links a < b: in order of ids, a node goes into its smallest neighbour before it that itself stays.

    The nodes that stay are the first maximal set without links, found by rounds: a node without open smaller neighbours
    stays, and its larger neighbours go. A round is four joins on ids over the links still open.
    """
    tables = Tables(links.sparkSession, "merge")
    links = tables.keep(links.select("a", "b").distinct())
    open_, gone = links, None
    while not open_.isEmpty():
        later = open_.select(F.col("b").alias("a")).distinct()
        go = tables.keep(open_.join(later, "a", "left_anti").select(F.col("b").alias("id")).distinct())
        gone = go if gone is None else gone.unionByName(go)
        left = open_.join(go.withColumnRenamed("id", "a"), "a", "left_anti").join(go.withColumnRenamed("id", "b"), "b", "left_anti")
        open_ = tables.keep(left, None if open_ is links else open_)
    if gone is None:
        return links.select(F.col("b").alias("id"), F.col("a").alias("into"))
    kept = links.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_semi")
    return tables.keep(kept.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("into")), links)
