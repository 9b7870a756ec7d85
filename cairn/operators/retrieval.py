"""Lexical, dense and fused retrieval over tables of chunks.

Ranked lists are rows (list_id, item, rank, score) with an explicit rank; ties go to the smaller item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..session import spread

K1, B, RRF_K = 1.5, 0.75, 60


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term, tf, doc_len of every distinct term of every chunk."""
    tok = chunks.select(F.col(id_col).alias("item"), TX.tokens(text_col).alias("tok"))
    tok = tok.select("item", F.size("tok").cast("long").alias("doc_len"), F.explode("tok").alias("term"))
    return tok.groupBy("item", "term", "doc_len").agg(F.count("*").alias("tf"))


def index_stats(chunks: DataFrame, text_col: str) -> DataFrame:
    """One row: n chunks, average length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(TX.token_count(F.coalesce(F.col(text_col), F.lit("")))).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def bm25(chunks: DataFrame, query: str | Column, id_col: str, text_col: str) -> DataFrame:
    """item, score of chunks that hold a query term. Other tokens are dropped before they become rows."""
    query = F.lit(query) if isinstance(query, str) else query
    wanted = F.array_distinct(TX.tokens(query))
    held = chunks.where(F.exists(wanted, lambda t: F.contains(F.lower(F.col(text_col)), t)))
    held = held.select(F.col(id_col).alias("item"), TX.token_count(text_col).cast("long").alias("doc_len"), TX.tokens(text_col).alias("tok"))
    held = held.select("item", "doc_len", F.explode(F.filter("tok", lambda t: F.array_contains(wanted, t))).alias("term"))
    post = held.groupBy("item", "term", "doc_len").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    stats = index_stats(chunks, text_col)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    long = 1 - B + B * F.col("doc_len") / F.col("avgdl")
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * long)
    scored = post.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    return scored.groupBy("item").agg(F.sum(part).alias("score"))


def dense(vectors: DataFrame, query: Column, id_col: str, vec_col: str) -> DataFrame:
    """item, score: cosine with the query vector."""
    q = V.normalize(query)
    return spread(vectors.select(id_col, vec_col)).select(F.col(id_col).alias("item"), V.dot(V.normalize(F.col(vec_col)), q).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best, ranked from 1."""
    best = scored.orderBy(F.desc("score"), "item").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "item")).cast("long"))


def rank_lists(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Ranks within each list_id."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("list_id").orderBy(F.desc("score"), "item")).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def fuse(ranked: list[DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: item, score = sum of 1 / (rrf_k + rank)."""
    every = reduce(DataFrame.unionByName, [r.select("item", "rank") for r in ranked])
    return every.groupBy("item").agg(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score"))


def clamp_k(k: int) -> int:
    """Results that a caller may ask for."""
    return min(20, max(1, k))


def candidate_size(k: int) -> int:
    """Candidates that are ranked again for k results."""
    return max(20, 3 * k)


def pool_size(k: int) -> int:
    return max(10 * k, 50)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: Column, k: int = 10, *, id_col="doc_id", text_col="text",
           vec_id="vec_id", vec_col="embedding", extra: list[DataFrame] | None = None, index=None) -> DataFrame:
    """item, rank, score: dense and lexical ranks fused, with further ranked lists if given. index: a stored one of the chunks."""
    pool = pool_size(k)
    lexical = index.search(query) if index else bm25(chunks, query, id_col, text_col)
    lists = [top(dense(vectors, query_vector, vec_id, vec_col), pool), top(lexical, pool), *(extra or [])]
    return top(fuse(lists), k)


def multi_hybrid(chunks: DataFrame, vectors: DataFrame, variants: list[tuple[str, Column]], k: int = 10, *, extra: list[DataFrame] | None = None, index=None, **cols) -> DataFrame:
    """All variants' dense and lexical lists, and further ones if given, in one fusion."""
    pool = pool_size(k)
    lists = list(extra or [])
    for text, vector in variants:
        lists.append(top(dense(vectors, vector, cols.get("vec_id", "vec_id"), cols.get("vec_col", "embedding")), pool))
        lists.append(top(index.search(text) if index else bm25(chunks, text, cols.get("id_col", "doc_id"), cols.get("text_col", "text")), pool))
    return top(fuse(lists), k)


def query_variants(original: str, others: list[str], most: int = 3) -> list[str]:
    """The original first, distinct without regard to case."""
    seen, out = set(), []
    for q in [original, *others]:
        q = " ".join(q.split())
        if q and q.lower() not in seen:
            seen.add(q.lower())
            out.append(q)
    return out[:most]


def calibrate(vectors: DataFrame, vec_col: str) -> DataFrame:
    """dim, scale: the largest absolute value of each dimension; one where that is zero."""
    each = vectors.select(F.posexplode(vec_col).alias("dim", "x"))
    s = each.groupBy("dim").agg(F.max(F.abs(F.col("x").cast("double"))).alias("scale"))
    return s.select("dim", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)).alias("scale"))


def scale_array(scales: DataFrame) -> DataFrame:
    """One row with the scales in order of dimension."""
    return scales.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "scale"))), lambda x: x.scale).alias("scale"))


# fixed values: words of a query that say nothing of its coverage
QUERY_STOPWORDS = "a an and are as at be by for from how in is it of on or the to what when where which who with".split()


def confidence(hits: DataFrame, query: str, graph: bool = False, top_n: int = 6) -> DataFrame:
    """One row: level (strong, weak, empty), share of query terms in the best hit, distinct documents, whether the graph supports it.

    hits: rank, text, url, name.
    """
    terms = TX.without(TX.long_terms(F.lit(query)), QUERY_STOPWORDS)
    best = hits.where(F.col("rank") <= top_n)
    share = F.size(F.array_intersect(terms, TX.tokens("text"))) / F.greatest(F.size(terms), F.lit(1))
    out = best.agg(
        F.count("*").alias("n"), F.coalesce(F.max(share), F.lit(0.0)).alias("coverage"),
        F.countDistinct(F.coalesce(F.nullif("url", F.lit("")), F.col("name"))).alias("sources"),
    )
    strong = (F.col("coverage") >= 0.6) | (F.lit(graph) & (F.col("coverage") >= 0.3))
    level = F.when(F.col("n") == 0, "empty").when(strong, "strong").otherwise("weak")
    return out.select(level.alias("level"), "coverage", "sources", (F.lit(graph) & (F.col("n") > 0)).alias("graph"))


def evaluate(cases: DataFrame, rankings: DataFrame, k: int) -> DataFrame:
    """Macro-averaged recall@k, hit@k, MRR and invalid references. cases: id, relevant, n_items; rankings: id, ranking."""
    both = cases.join(rankings, "id", "left").withColumn("ranking", F.coalesce("ranking", F.array().cast("array<long>")))
    head = F.slice("ranking", 1, k)
    hits = F.size(F.array_intersect(head, "relevant"))
    first = F.array_min(F.filter(F.transform("relevant", lambda r: F.array_position(F.col("ranking"), r)), lambda p: p > 0))
    both = both.select(
        (hits / F.greatest(F.size("relevant"), F.lit(1))).alias("recall"), (hits > 0).cast("double").alias("hit"),
        F.coalesce(1 / first, F.lit(0.0)).alias("rr"),
        F.size(F.filter("ranking", lambda i: (i < 0) | (i >= F.col("n_items")))).alias("bad"),
    )
    return both.agg(F.avg("recall").alias("recall"), F.avg("hit").alias("hit"), F.avg("rr").alias("mrr"), F.sum("bad").alias("invalid"))


def resolve_citations(ids: DataFrame, sentences: DataFrame, docs: DataFrame) -> DataFrame:
    """Sentence ids to sentence, chunk and document; unknown ids are dropped, unknown documents are null."""
    return ids.join(sentences, "sentence_id").join(docs, "doc_id", "left")
