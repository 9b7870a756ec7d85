"""Work by a caller's own functions: calls of a model, windowed extraction that resumes, jobs in bounded batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as TX
from ..functions import vectors as V
from ..sources import files
from . import assist, chunking, graph, records

#: Batches of a job after which its tables are written as one.
GATHERED = 16
#: Relations that a model may type, and themes that it may describe.
TYPED, THEMES = 50, 12


def with_calls(df: DataFrame, col: str, call: Callable[[str], str | None], name: str = "reply", at_once: int = 4) -> DataFrame:
    """Add the reply to each row's text. A task has ``at_once`` calls in flight; order is kept; a call that fails gives a null."""
    schema = StructType(list(df.schema.fields)).add(name, "string")
    at = df.columns.index(col)

    def safe(text):
        try:
            return None if text is None else call(text)
        except Exception:  # one failed call is one missing reply
            return None

    def run(batches):
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(pool.map(safe, b.column(at).to_pylist())), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def complete(df: DataFrame, prompt: str, call: Callable[[str], str | None], schema: str, name: str = "answer", at_once: int = 4) -> DataFrame:
    """Add a model's answer as a struct of this schema; replies in prose or fences are read, what cannot be is null, cut replies are marked."""
    out = with_calls(df, prompt, call, "__reply", at_once)
    return out.withColumn(name, TX.json_object("__reply", schema)).withColumn("truncated", F.coalesce(assist.looks_truncated(F.col("__reply")), F.lit(False))).drop("__reply")


def extract_windows(windows: DataFrame, done: DataFrame, call: Callable[[str], str | None], schema: str, col: str = "text", at_once: int = 4) -> DataFrame:
    """doc_id, window_idx, hash, answer of the windows that ``done`` (doc_id, window_idx, hash) does not have for the same text.

    Append what is returned to ``done`` and call again after a failure: only windows without an answer are asked
    again, and those of documents that have changed since.
    """
    w = windows.withColumn("hash", F.sha2(F.col(col), 256))
    todo = w.join(done.select("doc_id", "window_idx", "hash"), ["doc_id", "window_idx", "hash"], "left_anti")
    return complete(todo, col, call, schema, "answer", at_once).where("answer is not null and not truncated").select("doc_id", "window_idx", "hash", "answer")


def entity_tables(spans: DataFrame, sentences: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes by normalised label, the first occurrence's label and type, and pairs (a, b, n) that share sentences of two to six entities.

    spans: window_id, doc_id, label, text, start, end, score; sentences: window_id, sentence_id, sentence_idx, start, end.
    First is in order of documents, windows and places.
    """
    inside = chunking.spans_in_sentences(spans, sentences.drop("sentence_id")).join(sentences.select("window_id", "sentence_idx", "sentence_id"), ["window_id", "sentence_idx"])
    rows = inside.select(
        F.struct("doc_id", "window_id", "start", "end").alias("seq"), F.col("text").alias("label"), assist.map_label(F.col("label"), types, "other").alias("type"),
        F.array("sentence_id").alias("evidence"), F.array(F.col("doc_id").cast("string")).alias("doc_ids"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("summary"), "sentence_id",
    )
    nodes = graph.merge_nodes(rows.drop("sentence_id").withColumn("id", F.lit("")))
    mentions = rows.select("sentence_id", F.concat(F.lit("n_"), TX.short_hash(TX.norm_label("label"))).alias("entity"))
    return nodes, chunking.cooccurrence(mentions)


def entity_graph(spans: DataFrame, sentences: DataFrame, types: dict[str, str], similar: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and communities of the entities that a recogniser has found.

    Entities of one normalised label are one node (``entity_tables``); those that occur together in a sentence of two to
    six are linked; ``similar`` (a < b of node ids) are merged greedily where their types allow it.
    """
    nodes, together = entity_tables(spans, sentences, types)
    pairs = together.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("related to").alias("relation"), F.col("n").alias("weight"))
    if similar is not None:
        into = graph.greedy_merge(nodes, similar)
        nodes = nodes.join(into.select("id"), "id", "left_anti")
        r = into.select(F.col("id").alias("src"), F.col("into").alias("__s"))
        d = into.select(F.col("id").alias("dst"), F.col("into").alias("__d"))
        pairs = pairs.join(r, "src", "left").join(d, "dst", "left")
        pairs = pairs.select(F.coalesce("__s", "src").alias("src"), F.coalesce("__d", "dst").alias("dst"), "relation", "weight").where("src <> dst")
        pairs = pairs.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "relation").agg(F.sum("weight").alias("weight"))
    return nodes, pairs, graph.communities_by_label(graph.label_propagation(pairs), 3, THEMES)


def entity_vectors(nodes: DataFrame, path: str, model: str, embed: Callable) -> DataFrame:
    """nodes with their vector v, of length one: embedded once for each text, whichever build has met it first.

    ``path`` is a table of (key, model, v), where key is the SHA-256 of a node's text, its label and summary. Texts that
    the model has no vector of there are embedded, each once, and appended; vectors of another model are not read.
    """
    spark = nodes.sparkSession
    text = F.trim(F.concat_ws(" — ", "label", F.nullif("summary", F.lit(""))))
    keyed = nodes.withColumn("__text", text).withColumn("__key", F.sha2("__text", 256))

    def known() -> DataFrame:
        if not files.exists(spark, path):
            return spark.createDataFrame([], "__key string, v array<double>")
        rows = spark.read.schema("key string, v array<double>, model string").parquet(path).where(F.col("model") == model)
        return rows.groupBy(F.col("key").alias("__key")).agg(F.first("v").alias("v"))  # builds at one time may both have added a text

    new = keyed.select("__key", "__text").distinct().join(known().select("__key"), "__key", "left_anti")
    new = new.select(F.col("__key").alias("key"), embed(F.col("__text")).alias("v"))
    new = new.select("key", V.normalize(F.col("v")).alias("v"), F.lit(model).alias("model"))
    new.write.mode("append").partitionBy("model").parquet(path)
    return keyed.join(known(), "__key", "left").drop("__key", "__text")


def enrich(edges: DataFrame, members: DataFrame, call: Callable[[str], str | None], dirty: DataFrame | None = None, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """Relations of the edges between the busiest entities, and summaries of the communities, by a bounded number of calls.

    edges: src, dst, relation, text (what is asked); members: community, text. Of communities only those in
    ``dirty`` (community) are asked, if given. What fails keeps its relation, or has no summary.
    """
    best = assist.edges_to_type(edges, TYPED)
    typed = with_calls(best, "text", call, "__said", at_once)
    typed = typed.withColumn("relation", F.coalesce(F.nullif(TX.norm_label("__said"), F.lit("")), F.col("relation"))).select("src", "dst", "relation")
    kept = edges.select("src", "dst", "relation").join(F.broadcast(typed.select("src", "dst")), ["src", "dst"], "left_anti")  # TYPED rows
    asked = members if dirty is None else members.join(dirty, "community", "left_semi")
    return kept.unionByName(typed), with_calls(asked.orderBy("community").limit(THEMES), "text", call, "summary", at_once).select("community", "summary")


@dataclass
class Handler:
    """One kind of job: its first items, what it finds at an item, and its report."""

    seed: Callable[[], DataFrame]
    run_items: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    reduce: Callable[[DataFrame], DataFrame]


def run_job(handler: Handler, key: str, depth: int, cap: int, batch: int, write: Callable[[DataFrame, str, int], DataFrame], seconds: float | None = None) -> Iterator[dict]:
    """Run a job batch by batch, and say after each what is done; the report comes last.

    ``seed`` gives items (key, depth); ``run_items`` takes a batch and gives its findings and the items that it has
    led to. ``write`` (rows, name, number) keeps a table and returns it as read again, so that a job that is
    stopped goes on from its tables. Past ``seconds`` no further batch begins, and the rest is reported as pending.
    """
    began, number, n_found = time.monotonic(), 0, 0
    frontier = seen = write(handler.seed().dropDuplicates([key]).orderBy(key).limit(cap), "frontier", 0)
    pending, findings = frontier.count(), None
    while pending and (seconds is None or time.monotonic() - began < seconds):
        now, later = assist.take_batch(frontier, batch, ["depth", key])
        number += 1
        found, led = handler.run_items(now)
        found = write(found, "findings", number)
        n_found += found.count()
        findings = found if findings is None else findings.unionByName(found)
        fresh = records.frontier_add(seen, led, key, [key], depth, cap)
        fresh = write(fresh.select(key, "depth"), "added", number)
        seen, frontier = seen.unionByName(fresh), write(later.unionByName(fresh), "frontier", number)
        if number % GATHERED == 0:  # plans over tables of many batches stay short
            findings, seen = write(findings, "all_findings", number), write(seen, "all_seen", number)
        pending = frontier.count()
        yield {"batch": number, "findings": n_found, "pending": pending, "report": None}
    yield {"batch": number, "findings": n_found, "pending": pending, "report": handler.reduce(findings) if findings is not None else None}
