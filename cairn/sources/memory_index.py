"""A repository that indexes the memories of a graph: found by text and vector, never shown as a collection of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import parsing
from .repository import MEMORY, Repository

SCHEME = "memory:"


def _key(node_id: Column) -> Column:
    return F.xxhash64(node_id.cast("string"))


class MemoryIndex:
    """One memory is one document of one text, ``label: summary``; its address leads back to its id."""

    def __init__(self, repo: Repository):
        self.repo = repo

    def upsert(self, nodes: DataFrame, embed, embed_model: str | None = None) -> int:
        """nodes: id, label, summary. Those that are there are replaced. Another embedder is refused: rebuild then."""
        docs = nodes.select(
            _key(F.col("id")).alias("doc_id"), F.col("label").alias("name"), parsing.memory_url(F.col("id").cast("string"), SCHEME).alias("url"),
            F.concat_ws(": ", "label", "summary").alias("text"),
        )
        return self.repo.add(docs, embed, embed_model=embed_model, kind=MEMORY)

    def remove(self, ids: DataFrame) -> int:
        return self.repo.delete(ids.select(_key(F.col("id")).alias("doc_id")))

    def rebuild(self, nodes: DataFrame, embed, embed_model: str | None = None) -> int:
        self.repo.drop()
        return self.upsert(nodes, embed, embed_model)

    def search(self, query: str, vector: Column, k: int, embed_model: str | None = None) -> DataFrame | None:
        """id, score, rank; None where there is no index, or one of another embedder."""
        made_by = self.repo.meta()["embed_model"]
        if not self.repo.log() or embed_model and made_by and embed_model != made_by:
            return None
        hits = self.repo.search(query, vector, k).join(self.repo.documents().select("doc_id", "url"), "doc_id")
        return hits.select(parsing.memory_id(F.col("url"), SCHEME).alias("id"), "score", "rank")
