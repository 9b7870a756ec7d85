"""Overviews and documents that a model writes about a repository: a chain of steps that goes on where it was stopped.

Each step's outcome is one commit of a store beside the repository, named by the product and by what it is made of (the
repository's revision or the graph's). A call finds the steps that are done and goes on with the next; a reply that was
paid for is never asked for again. The last step saves the product only if no other call has saved in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources.commits import Commits
from . import assist, chunking, graph, parsing, records, retrieval
from .jobs import with_calls

#: fixed values: passages of a sample, characters of each and of all together, entities of a graph's context
SAMPLE, PASSAGE, BUDGET, ENTITIES = 40, 600, 16_000, 30
#: fixed values: titles of documents by their kind, before the repository's name
TITLES = {"briefing": "Briefing", "faq": "FAQ", "study_guide": "Study guide"}
STEPS = "made_of string, step string, value string"


class StepFailed(Exception):
    """A step gave nothing usable; it is tried again by the next call."""


class Products(Commits):
    """The products of one repository: steps (product, made_of, step, value) and products (product, value), the last of each."""

    SCHEMAS = {"steps": f"product string, {STEPS}, revision int, attempt string", "products": "product string, value string, revision int, attempt string"}

    def done(self, product: str, made_of: str) -> dict[str, str]:
        rows = self.read("steps")
        if rows is None:
            return {}
        rows = rows.where((F.col("product") == product) & (F.col("made_of") == made_of))
        return {r.step: r.value for r in rows.groupBy("step").agg(F.max_by("value", "revision").alias("value")).collect()}  # a few steps

    def put(self, product: str, made_of: str, step: str, value: str) -> int:
        return self.commit({"steps": self.spark.createDataFrame([(product, made_of, step, value)], f"product string, {STEPS}")})

    def save(self, product: str, value: str, expected: int) -> int:
        return self.commit({"products": self.spark.createDataFrame([(product, value)], "product string, value string")}, expected)

    def product(self, product: str) -> str | None:
        rows = self.read("products")
        row = None if rows is None else rows.where(F.col("product") == product).orderBy(F.desc("revision")).first()
        return row.value if row else None


def _step(store: Products, product: str, made_of: str, name: str, make: Callable[[], str | None]) -> str:
    had = store.done(product, made_of).get(name)
    if had is not None:
        return had
    value = make()
    if value is None:
        raise StepFailed(f"{product}: {name}")
    store.put(product, made_of, name, value)
    return value


def sample_context(chunks: DataFrame, docs: DataFrame) -> str | None:
    """The names of all documents, and passages evenly spaced over the chunks, up to the budget; None without a chunk.

    chunks: doc_id, chunk_idx, text; docs: doc_id, name.
    """
    n = chunks.count()
    if not n:
        return None
    wanted = chunking.evenly(n, SAMPLE)  # SAMPLE places
    placed = records.ranked(chunks.select("doc_id", "chunk_idx", "text"), ["doc_id", "chunk_idx"], "place").withColumn("place", F.col("place") - 1)
    some = placed.where(F.col("place").isin(wanted)).join(docs.select("doc_id", "name"), "doc_id")
    some = some.withColumn("text", TX.squeeze_ends(F.substring("text", 1, PASSAGE))).where("text <> ''")
    told = assist.budget_prefix(some, ["place"], F.length("text"), BUDGET).orderBy("place").collect()
    names = [r.name or "" for r in docs.orderBy("doc_id").select("name").toLocalIterator()]
    return "\n".join([f"Documents ({len(names)}):", *[f"- {x}" for x in names], "", "Sample passages:", "\n\n".join(f"[{r.name}] {r.text}" for r in told)])


def graph_context(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> str | None:
    """Themes, the entities of the largest degree and the relations between them, with the sentences that they cite; None without a node."""
    if nodes.isEmpty():
        return None
    cite = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " ")
    top = graph.top_entities(nodes, edges, ENTITIES)  # ENTITIES rows
    between = graph.edge_labels(graph.induced(edges, top), top)
    lines = lambda df, text: [r.line for r in df.select(text.alias("line")).collect()]
    parts = []
    if communities is not None and not communities.isEmpty():
        said = F.concat_ws(" ", F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(":")), "summary", cite(F.col("evidence")))
        parts += ["Themes:", *lines(communities.orderBy("seq").limit(12), said), ""]
    parts += ["Entities:", *lines(top.orderBy(F.desc("degree"), "id"), F.concat_ws(" ", F.concat(F.lit("- "), "label", F.lit(" ("), F.coalesce("type", F.lit("other")), F.lit(")")), "summary", cite(F.col("evidence"))))]
    parts += ["", "Relations:", *lines(between.orderBy("src_label", "relation", "dst_label"), F.concat_ws(" ", F.format_string("- %s -[%s]-> %s", "src_label", "relation", "dst_label"), cite(F.col("evidence"))))]
    return "\n".join(parts)


def _called(store: Products, prompt: str, call: Callable[[str], str | None]) -> str | None:
    row = with_calls(store.spark.createDataFrame([(prompt,)], "prompt string"), "prompt", call).first()
    return row.reply if row.reply and row.reply.strip() else None


def overview(store: Products, chunks: DataFrame, docs: DataFrame, revision: int, call: Callable[[str], str | None]) -> str:
    """A repository's overview as JSON: sample, call, parse, save. StepFailed where a step gives nothing; the ones before it are kept."""
    made_of, name = f"revision {revision}", "overview"
    context = _step(store, name, made_of, "sample", lambda: sample_context(chunks, docs))
    reply = _step(store, name, made_of, "reply", lambda: _called(store, context, call))

    def parse() -> str | None:
        row = store.spark.createDataFrame([(reply,)], "reply string").select(F.to_json(parsing.overview(F.col("reply"))).alias("o")).first()
        return row.o

    read = _step(store, name, made_of, "parsed", parse)

    def save() -> str:
        counts = F.struct(F.lit(docs.count()).alias("docs"), F.lit(chunks.count()).alias("chunks"))
        kind = "title string, overview string, topics array<string>, questions array<string>"
        o = F.from_json("o", kind)
        row = store.spark.createDataFrame([(read,)], "o string").select(F.to_json(F.struct(o.alias("overview"), counts.alias("made_of"))).alias("o")).first()
        store.save(name, row.o, store.revision())
        return row.o

    return _step(store, name, made_of, "saved", save)


def studio(
    store: Products, kind: str, repo: str, nodes: DataFrame, edges: DataFrame, communities: DataFrame | None, sentences: DataFrame, revision: int,
    call: Callable[[str], str | None],
) -> str:
    """A document of a kind in TITLES as JSON, written from the graph: context, call, citations of known sentences only, save.

    sentences: sentence_id, doc_id, text.
    """
    made_of = f"graph {revision}"
    context = _step(store, kind, made_of, "context", lambda: graph_context(nodes, edges, communities))
    reply = _step(store, kind, made_of, "reply", lambda: _called(store, context, call))

    def cite() -> str:
        one = store.spark.createDataFrame([(0, reply.strip())], "key int, text string")
        ids = one.select(F.posexplode(TX.citation_ids("text")).alias("at", "sentence_id"))
        found = retrieval.resolve_citations(ids, sentences.select("sentence_id", "doc_id", "text"), sentences.select("doc_id").distinct()).orderBy("at").collect()
        clean = assist.clean_citations(one, "text", sentences.select(F.col("sentence_id").alias("id"))).first().text
        cited = [(r.sentence_id, str(r.doc_id), r.text) for r in found]  # of one reply
        row = store.spark.createDataFrame([(kind, f"{TITLES[kind]} — {repo}", clean, cited)], "kind string, title string, markdown string, citations array<struct<sentence_id:string,doc_id:string,text:string>>")
        return row.select(F.to_json(F.struct("*")).alias("o")).first().o

    product = _step(store, kind, made_of, "cited", cite)

    def save() -> str:
        store.save(kind, product, store.revision())
        return product

    return _step(store, kind, made_of, "saved", save)
