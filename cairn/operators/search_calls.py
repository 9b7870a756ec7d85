"""The calls that a user of the collections makes: search of a repository, of its graph, of its themes, and recall of memories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import assist, graph, memory, retrieval


@dataclass
class StoredGraph:
    """A graph of a repository and the revision that it was made of. Columns as in ``graph``; communities: id, seq, title, summary, node_ids, evidence."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    revision: int = 0


@dataclass
class Corpus:
    """chunks: item, text, name, url; vectors: item, v; sentences: sentence_id, item, start, end, text."""

    chunks: DataFrame
    vectors: DataFrame
    sentences: DataFrame
    revision: int = 0
    index: object = None
    stored_graph: StoredGraph | None = None


def repo_search(
    corpus: Corpus, queries: list[str], vectors: list[Column], k: int = 10, hybrid: bool = True, graph_assist: bool = True
) -> tuple[DataFrame, dict]:
    """item, rank, score, text, name, url of the k best chunks, and what the graph had to do with it.

    graph_status: disabled, hybrid_disabled, no_graph, stale_graph (it was made of another revision), no_match or
    used. One query and vector are searched by both ways and fused, several all together; without ``hybrid`` only
    the vectors are, and without a query too.
    """
    k = retrieval.clamp_k(k)
    several = len(vectors) > 1 or len(queries) > 1
    both = hybrid and bool(queries)
    stored = corpus.stored_graph if both and graph_assist else None
    fresh = stored if stored and stored.revision == corpus.revision else None
    ranked = []
    if fresh:
        for q in queries:
            found = graph.graph_evidence(fresh.nodes, fresh.edges, fresh.communities, q)
            ranked.append(graph.graph_chunks(found, corpus.sentences))
        ranked = [r for r in ranked if not r.isEmpty()]
    status = (
        "disabled" if not graph_assist else "hybrid_disabled" if not both else "no_graph" if not stored
        else "stale_graph" if not fresh else "used" if ranked else "no_match"
    )
    cols = {"id_col": "item", "vec_id": "item", "vec_col": "v"}
    if not both:
        pool = retrieval.pool_size(k)
        lists = [retrieval.top(retrieval.dense(corpus.vectors, v, "item", "v"), pool) for v in vectors]
        hits = retrieval.top(retrieval.fuse(lists), k) if several else retrieval.top(retrieval.dense(corpus.vectors, vectors[0], "item", "v"), k)
    elif several:
        variants = [(queries[min(i, len(queries) - 1)], vectors[min(i, len(vectors) - 1)]) for i in range(max(len(queries), len(vectors)))]
        hits = retrieval.multi_hybrid(corpus.chunks, corpus.vectors, variants, k, extra=ranked, index=corpus.index, text_col="text", **cols)
    else:
        hits = retrieval.hybrid(corpus.chunks, corpus.vectors, queries[0], vectors[0], k, extra=ranked, index=corpus.index, text_col="text", **cols)
    candidates = sorted({r.item for x in ranked for r in x.select("item").collect()}, key=repr)  # 50 a query at most
    return hits.join(corpus.chunks, "item"), {"graph_status": status, "graph_rankings": len(ranked), "graph_candidates": len(candidates)}


def search_repo(
    corpus: Corpus, query: str, embed: Callable[[str], Column], k: int = 5,
    expand: Callable[[str], list[str]] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, dict]:
    """Search, and where that is weak once more with the variants of ``expand``; then the order of ``rerank`` (item, pos) over the candidates."""
    size = retrieval.candidate_size(retrieval.clamp_k(k))
    hits, about = repo_search(corpus, [query], [embed(query)], size)
    level = retrieval.confidence(hits, query, about["graph_candidates"] > 0).first().level
    if level == "weak" and expand:
        queries = retrieval.query_variants(query, expand(query))
        hits, about = repo_search(corpus, queries, [embed(q) for q in queries], size)
    if rerank:
        hits = assist.rerank(hits, rerank(hits), retrieval.clamp_k(k)).withColumn("rank", F.col("new_rank").cast("long")).drop("new_rank")
    return hits.where(F.col("rank") <= retrieval.clamp_k(k)), {**about, "confidence": level}


def cited(rows: DataFrame, sentences: DataFrame, keep: list[str], most: int = 12) -> DataFrame:
    """``keep`` and citations: the sentences (sentence_id, item, text) of the first ``most`` evidence ids that there are."""
    ids = rows.select(*keep, F.posexplode(F.slice("evidence", 1, most)).alias("at", "sentence_id"))
    found = ids.join(sentences.select("sentence_id", "item", "text"), "sentence_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence_id", "item", "text"))), lambda x: F.struct(x.sentence_id, x["item"], x.text))
    got = found.groupBy(*keep).agg(listed.alias("citations"))
    return rows.select(*keep).join(got, keep, "left")


def search_graph(stored: StoredGraph, sentences: DataFrame, query: str, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """The entities that share most terms with the query and all relations that touch them, each with its citations."""
    nodes, edges = graph.subgraph(stored.nodes, stored.edges, query, k)
    named = graph.edge_labels(edges, stored.nodes)
    return cited(nodes, sentences, ["id", "label", "type", "summary", "score"]), cited(named, sentences, ["id", "src_label", "relation", "dst_label"])


def global_search(stored: StoredGraph, sentences: DataFrame, query: str, n: int = 5) -> DataFrame:
    """The communities nearest to the query with their citations; for one that names no theme, the first in their own order."""
    best = assist.community_rank(stored.communities, query, n, stored.nodes, stored.edges)
    return cited(best, sentences, ["id", "title", "summary"])


def memory_text(nodes: DataFrame) -> DataFrame:
    """item, text of every memory: its label and summary."""
    return nodes.select(F.col("id").alias("item"), F.concat_ws(": ", "label", "summary").alias("text"))


def recall(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, query: str, vector: Column, now: Column, k: int = 8, project: str | None = None,
    told: int = memory.CORE,
) -> DataFrame:
    """Memories found for a query, and their neighbours over active edges, but for the ``told`` ones that are told anyhow as the core.

    vectors: item, v. rank is null for a neighbour.
    """
    told = memory.core(nodes, now, told, project).select("id")
    hits = retrieval.hybrid(memory_text(nodes), vectors, query, vector, k, id_col="item", vec_id="item", vec_col="v").select(F.col("item").alias("id"), "rank")
    near = graph.touching(edges.where("status = 'active'"), hits).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    every = near.join(hits, "id", "left_anti").withColumn("rank", F.lit(None).cast("long")).unionByName(hits).join(told, "id", "left_anti")
    return every.join(nodes.where("status <> 'superseded'"), "id")
