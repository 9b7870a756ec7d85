"""Smaller operators around retrieval, graphs, schedules and conversations."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import urls as U
from . import graph, records


def rerank(hits: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """Hits (item, rank) by a model's order (item, pos); invalid and repeated items are dropped, the rest fills up."""
    first = order.groupBy("item").agg(F.min("pos").alias("pos"))
    j = hits.join(first, "item", "left").withColumn("key", F.struct(F.col("pos").isNull().alias("none"), F.coalesce("pos", "rank").alias("at"), "item"))
    best = j.orderBy("key").limit(k)  # what is numbered is k rows
    return best.withColumn("new_rank", F.row_number().over(W.orderBy("key"))).drop("key", "pos")


def clean_citations(df: DataFrame, col: str, known: DataFrame) -> DataFrame:
    """[[ids]] groups with unknown ids left out; empty groups go. df: key, text; known: id.

    Only the cited ids meet the known ones, so the known table is never sent around.
    """
    ids = df.select("key", F.explode(TX.citation_ids(col)).alias("id")).join(known.select("id"), "id", "left_semi")
    ids = ids.groupBy("key").agg(F.collect_set("id").alias("__ids"))

    def swap(texts: pd.Series, allowed: pd.Series) -> pd.Series:
        def one(text, ids):
            ids = set(ids if ids is not None else ())

            def group(m):
                kept = [s for s in map(str.strip, re.split("[,;|]", m[1])) if s in ids]
                return f"[[{', '.join(dict.fromkeys(kept))}]]" if kept else ""

            return None if text is None else re.sub(r"\[\[([^\[\]]+)\]\]", group, text)

        return pd.Series([one(t, a) for t, a in zip(texts, allowed)])

    return df.join(ids, "key", "left").withColumn(col, F.pandas_udf(swap, "string")(F.col(col), F.col("__ids"))).drop("__ids")


def looks_truncated(text: Column) -> Column:
    """JSON-like text that ends inside a string, or whose brackets outside strings do not all close."""
    outside = F.regexp_replace(F.coalesce(text, F.lit("")), r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    before = F.regexp_replace(outside, r'(?s)".*$', "")
    return outside.contains('"') | (F.regexp_count(before, F.lit(r"[{\[]")) > F.regexp_count(before, F.lit(r"[}\]]")))


def split_window(df: DataFrame, col: str) -> DataFrame:
    """Each window as two halves by line: half 0 and 1, empty ones dropped."""
    lines = F.split(col, "\n")
    mid = F.ceil(F.size(lines) / 2).cast("int")
    halves = F.array(F.slice(lines, 1, mid), F.slice(lines, mid + 1, F.size(lines)))
    out = df.select(*[c for c in df.columns if c != col], F.posexplode(halves).alias("half", "__l"))
    return out.withColumn(col, F.array_join("__l", "\n")).drop("__l").where(F.col(col) != "")


# fixed values: function words, names of several words, and signs of tables and lists
STOPWORDS = (
    "a an and are as at be but by for from has have he i in is it its may might no not of on or she should so such than that the their then they this "
    "to was we were which who will with would you"
).split()
# within a line. Possessive: a line of thousands of such words takes no depth of the stack; no end is asked for, as a name always has one
NAME = r"[A-Z](?<!\w[A-Z])[\w&.'-]*+(?:[ \t\x0B\f\r]++[A-Z][\w&.'-]*+)++"
TABLE_SIGN = "[0-9.·…\t]"
#: a line that is repeated is a running header only if it is as short as this
HEADER = 80


def window_information(df: DataFrame, col: str) -> DataFrame:
    """Add ``information`` (0 to 1): words a line, names a line, signs of tables, function words, repeated short lines.

    Needs doc_id and window_idx. A short line is repeated if its document has it before, in this window or an
    earlier one. Lines lose a leading [[id]] and blank ends; a window without lines has none.
    """
    squeezed = F.transform(F.split(F.col(col), "\n"), lambda s: TX.squeeze_ends(F.regexp_replace(s, r"^\[\[[^\]]+\]\]\s*", "")))
    rows = df.withColumn("__lines", F.filter(squeezed, lambda s: s != ""))
    each = rows.select("doc_id", "window_idx", F.posexplode("__lines").alias("__no", "__line")).withColumn("__line", F.lower("__line"))
    each = each.where(F.length("__line") <= HEADER)
    seen = W.partitionBy("doc_id", "__line").orderBy("window_idx", "__no")
    again = each.withColumn("__k", F.row_number().over(seen)).where("__k > 1").groupBy("doc_id", "window_idx").agg(F.count("*").alias("__again"))
    rows = rows.join(again, ["doc_id", "window_idx"], "left")
    # each measure is taken once, of the lines as one text
    whole = rows.withColumns({"__n": F.size("__lines"), "__whole": F.array_join("__lines", "\n")})
    plain = F.split(F.regexp_replace(F.lower("__whole"), r"(?U)[^a-z'\s]++", ""), r"(?U)\s+")
    taken = whole.withColumns(
        {
            "__words": F.regexp_count("__whole", F.lit(r"(?U)\S++")),
            "__names": F.regexp_count("__whole", F.lit(NAME)),
            "__signs": F.regexp_count("__whole", F.lit(TABLE_SIGN)),
            "__stop": F.size(F.filter(plain, lambda w: w.isin(STOPWORDS))),
            "__chars": F.length("__whole") - F.col("__n") + 1,
        }
    )
    n, words, stop = F.col("__n"), F.col("__words"), F.col("__stop") / F.col("__words")
    part = lambda x: F.least(x, F.lit(1.0))
    score = (
        0.35 * part(words / n / 8) + 0.2 * part(F.col("__names") / n) + 0.2 * (1 - part(F.col("__signs") / F.col("__chars") * 4))
        + 0.1 * F.when(stop.between(0.15, 0.6), 1.0).otherwise(0.3) + 0.15 * (1 - part(F.coalesce("__again", F.lit(0)) / n))
    )
    made = "__lines", "__again", "__n", "__whole", "__words", "__names", "__signs", "__stop", "__chars"
    return taken.withColumn("information", F.when(n > 0, score).otherwise(0.0)).drop(*made)


def low_information(windows: DataFrame, least: float = 0.25) -> DataFrame:
    """Add ``skipped``: below ``least``, never a document's first or last window, at most half of them. Needs doc_id, window_idx, information."""
    w = W.partitionBy("doc_id")
    inner = windows.withColumns({"__n": F.count("*").over(w), "__lo": F.min("window_idx").over(w), "__hi": F.max("window_idx").over(w)})
    can = (F.col("information") < least) & (F.col("window_idx") > F.col("__lo")) & (F.col("window_idx") < F.col("__hi"))
    inner = inner.withColumn("__can", can).withColumn("__r", F.row_number().over(W.partitionBy("doc_id", "__can").orderBy("information", "window_idx")))
    return inner.withColumn("skipped", F.col("__can") & (F.col("__r") <= F.floor(F.col("__n") * 0.5))).drop("__n", "__lo", "__hi", "__can", "__r")


def budget_prefix(df: DataFrame, order: list[str], size: Column, budget: int, partition: list[str] | None = None) -> DataFrame:
    """Rows in order until the next would overflow the budget."""
    if not partition:
        return records.running_total(df, order, size, "__t").where(F.col("__t") <= budget).drop("__t")
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__t", F.sum(size).over(w)).where(F.col("__t") <= budget).drop("__t")


# fixed values: what stands for an output that was left out, and marks of outputs that already were
COMPACTED = "[compacted — important results are in Findings]"
COMPACTED_IMAGE = "[compacted — earlier captured page frame(s) removed to save context]"
LEFT_OUT = r"^(\[compacted|\[summary\])"


def compaction(messages: DataFrame, budget: int, tail: int = 6) -> DataFrame:
    """Add ``evicted``: the oldest tool outputs and images, as many as bring a conversation down to the budget.

    messages: conv_id, seq, role, text and, if any, image (boolean). The first row and the last ``tail`` stay,
    so do outputs that were left out before. Each evicted row is counted as its placeholder from then on.
    """
    image = F.col("image") if "image" in messages.columns else F.lit(False)
    w = W.partitionBy("conv_id")
    m = messages.withColumns({"__n": F.length("text"), "__i": F.row_number().over(w.orderBy("seq")), "__r": F.row_number().over(w.orderBy(F.desc("seq")))})
    tool = (F.col("role") == "tool") & ~F.col("text").rlike(LEFT_OUT)
    picture = (F.col("role") == "user") & image
    can = (F.col("__i") > 1) & (F.col("__r") > tail) & (tool | picture)
    saved = F.col("__n") - F.when(tool, len(COMPACTED)).otherwise(len(COMPACTED_IMAGE))
    m = m.withColumn("__can", can).withColumn("__saved", F.when(can, saved).otherwise(0))
    before = w.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("__left", F.sum("__n").over(w) - F.coalesce(F.sum("__saved").over(before), F.lit(0)))
    # the search ends at the first row that finds the conversation within its budget
    m = m.withColumn("__least", F.min("__left").over(w.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    return m.withColumn("evicted", F.col("__can") & (F.col("__least") > budget)).drop("__n", "__i", "__r", "__can", "__saved", "__left", "__least")


def merge_bookmarks(marks: DataFrame) -> DataFrame:
    """One row for each address without regard to case: first title, united tags, smallest place. marks: url, title, tags, pos."""
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tags"))), lambda x: x.tags)))
    return marks.groupBy(F.lower("url").alias("key")).agg(
        F.min_by("url", "pos").alias("url"), F.min_by("title", F.when(F.col("title") != "", F.col("pos"))).alias("title"), tags.alias("tags"), F.min("pos").alias("pos")
    )


def mention_rank(df: DataFrame, query: str, label: str, order: str, n: int = 20) -> DataFrame:
    """By how a label matches (whole, beginning, a word's beginning, inside), then by place."""
    q, x = query.lower(), F.lower(F.col(label))
    tier = F.when(x == q, 0).when(x.startswith(q), 1).when(F.contains(F.concat(F.lit(" "), x), F.lit(" " + q)), 2).when(x.contains(q), 3)
    return df.withColumn("tier", tier).where("tier is not null").orderBy("tier", order).limit(n)


def edges_to_type(edges: DataFrame, n: int = 50) -> DataFrame:
    """Edges whose ends have the largest degrees together."""
    d = graph.degree(edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    return e.withColumn("degree", F.col("ds") + F.col("dd")).drop("ds", "dd").orderBy(F.desc("degree"), "src", "dst").limit(n)


def community_summary(members: DataFrame, edges: DataFrame, limit: int = 600) -> DataFrame:
    """community, summary: its three labels and three relations of highest degree. members: community, id, label."""
    d = graph.degree(edges)
    m = members.join(d, "id", "left").withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc_nulls_last("degree"), "id")))
    top = lambda df, c: df.where("r <= 3").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]).alias(c))
    inner = edges.join(members.select(F.col("id").alias("src"), "community", F.col("label").alias("sl")), "src")
    inner = inner.join(members.select(F.col("id").alias("dst"), "community", F.col("label").alias("dl")), ["dst", "community"])
    inner = inner.withColumn("said", F.concat_ws(" ", "sl", "relation", "dl"))
    inner = inner.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("src", "dst", "relation")))
    out = top(m, "label").join(top(inner, "said"), "community", "left")
    text = F.concat(F.array_join("label", ", "), F.when(F.size("said") > 0, F.concat(F.lit(": "), F.array_join("said", "; "))).otherwise(F.lit("")))
    return out.select("community", F.substring(text, 1, limit).alias("summary"))


# fixed values: words of a query that name no theme
GLOBAL_TERMS = (
    "a all an and are collection corpus fit for how in it main notebook of or overview repository summarize summary the theme themes to together what whole with"
).split()


def community_rank(communities: DataFrame, query: str, n: int = 5, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Communities by shared terms with the query, 1 to 12 of them; a query that names no theme gives the first in their own order.

    communities: id, seq, title, summary, node_ids. A title's terms count 4, a summary's 1; of members a label's 3,
    the aliases' 2, a summary's and a type's 1; of relations inside 2. Communities without any are left out.
    """
    n = max(1, min(n, 12))
    terms = TX.without(TX.tokens(F.lit(query)), GLOBAL_TERMS)
    hit = lambda c: TX.overlap(TX.tokens(c), terms).cast("long")
    parts = [communities.select("id", (4 * hit(F.col("title")) + hit(F.col("summary"))).alias("score"))]
    if nodes is not None:
        aliases = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")
        worth = 3 * hit(F.col("label")) + 2 * hit(aliases) + hit(F.coalesce("summary", F.lit(""))) + hit(F.coalesce("type", F.lit("")))
        member = communities.select("id", F.explode(F.array_distinct("node_ids")).alias("node"))
        parts.append(member.join(nodes.select(F.col("id").alias("node"), worth.alias("score")).where("score > 0"), "node").select("id", "score"))
        if edges is not None:
            e = edges.select("src", "dst", (2 * hit(F.col("relation"))).alias("score")).where("score > 0")
            ends = member.withColumnRenamed("node", "src").join(e, "src")
            parts.append(ends.join(member.withColumnRenamed("node", "dst"), ["id", "dst"]).select("id", "score"))
    every = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"))
    general = communities.sparkSession.range(1).select(F.size(terms).alias("n")).first().n == 0
    c = communities.join(every, "id").withColumn("score", F.lit(0).cast("long") if general else F.col("score"))
    return c.where(F.lit(general) | (F.col("score") > 0)).orderBy(F.desc("score"), "seq").limit(n)


def shared_documents(topics: DataFrame) -> DataFrame:
    """Pairs a < b of topics with a document in common, and how many. topics: id, doc_ids."""
    return sharing(topics.select("id", F.explode(F.array_distinct("doc_ids")).alias("doc")))


def sharing(e: DataFrame) -> DataFrame:
    """The same of distinct rows id, doc: no topic's documents are gathered."""
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.id") < F.col("b.id")))
    return j.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("n_docs"))


def topic_graph(
    chunks: DataFrame, pairs: DataFrame, stopwords: list[str] | None = None, k: int = 5, least: int = 3, most: int = 12
) -> tuple[DataFrame, DataFrame]:
    """Topics and their links. chunks: id, doc_id, text; pairs: a, b, cosine of similar chunks.

    Nearest neighbours, communities by labels in order of ids, keyword titles, links where topics share documents.
    """
    edges = graph.knn(pairs, k).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    com = graph.communities_by_label(graph.label_propagation(edges), least, most)
    members = com.select("community", F.explode("node_ids").alias("id")).hint("shuffle_merge").join(chunks, "id")  # by shuffle: a community may hold any number
    words = graph.cluster_keywords(members.select(F.col("community").alias("cluster"), "text"), stopwords).withColumnRenamed("cluster", "community")
    docs = members.groupBy("community").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    topics = com.join(docs, "community").join(words, "community", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    topics = topics.withColumnRenamed("community", "id")
    return topics, shared_documents(topics)


# fixed values: title of a topic without keywords, relation of topics that share documents
UNTITLED, RELATED = "Untitled topic", "related topic"


def topic_nodes(topics: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and links of ``topic_graph`` as nodes and edges of a graph; a topic's id follows from its members."""
    label = F.array_join(F.slice("keywords", 1, 3), ", ")
    words = F.array_join("keywords", ", ")
    summary = F.format_string("A cluster of %d related passage(s) across %d document(s): %s.", F.col("size"), F.size("doc_ids"), words)
    members = F.array_sort(F.transform("node_ids", lambda x: x.cast("string")))
    named = topics.select(F.col("id").alias("topic"), F.concat(F.lit("topic_"), TX.short_hash(F.array_join(members, ","))).alias("id"),
        F.lit("topic").alias("type"), F.when(label == "", UNTITLED).otherwise(label).alias("label"), F.col("keywords").alias("aliases"), summary.alias("summary"),
        F.transform("doc_ids", lambda d: d.cast("string")).alias("doc_ids"))
    ends = named.select("topic", "id")
    e = links.join(ends.select(F.col("topic").alias("a"), F.col("id").alias("src")), "a").join(ends.select(F.col("topic").alias("b"), F.col("id").alias("dst")), "b")
    e = e.select(F.concat(F.lit("topic_e_"), TX.short_hash(F.concat_ws("|", "src", "dst"))).alias("id"), "src", "dst", F.lit(RELATED).alias("relation"))
    return named.drop("topic"), e


def replace_topics(nodes: DataFrame, edges: DataFrame, topics: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with its topic nodes, and the edges at them, replaced by new ones (``topic_nodes``); other nodes and edges stay."""
    old = nodes.where("type = 'topic'").select("id")
    kept = edges.join(old.withColumnRenamed("id", "src"), "src", "left_anti").join(old.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where("type <> 'topic' or type is null").unionByName(topics, True), kept.unionByName(links, True)


def coverage(selected: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id, selected, completed, pending window sets. Both: doc_id, window_idx."""
    s = selected.distinct().join(done.distinct().withColumn("__done", F.lit(True)), ["doc_id", "window_idx"], "left")
    return s.groupBy("doc_id").agg(
        F.count("*").alias("selected"), F.count("__done").alias("completed"),
        F.sort_array(F.collect_list(F.when(F.col("__done").isNull(), F.col("window_idx")))).alias("pending"),
    )


def reset_changed(state: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Rows of state (doc_id, hash, ...) whose document's text is still the same."""
    now = docs.select("doc_id", F.sha2(F.col(text_col), 256).alias("hash"))
    return state.join(now, ["doc_id", "hash"], "left_semi")


def take_batch(frontier: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The next n pending items and the rest."""
    r = records.ranked(frontier, order, "__r")
    return r.where(F.col("__r") <= n).drop("__r"), r.where(F.col("__r") > n).drop("__r")


def research_reduce(findings: DataFrame) -> DataFrame:
    """Usable findings and distinct http sources. findings: text, sources."""
    usable = findings.where(F.length(F.trim("text")) > 0)
    return usable.agg(
        F.count("*").alias("n_findings"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.filter("sources", lambda s: U.is_http(s)))))).alias("sources"),
    )


def pivot_cells(df: DataFrame, cells: str, keys: list[str]) -> DataFrame:
    """Columns from an array of (key, value) cells; of repeated keys the first."""
    get = lambda k: F.try_element_at(F.filter(cells, lambda c: c.key == k), F.lit(1)).value
    return df.select(*[c for c in df.columns if c != cells], *[get(k).alias(k) for k in keys])


def event_stream(text: Column) -> Column:
    """The payloads of ``data:`` lines, or the whole text if it has none."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^data:\s*(.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def local_time(x: Column) -> Column:
    """(hour, minute) of a strict HH:MM, else null."""
    ok = x.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(ok, F.struct(F.substring(x, 1, 2).cast("int").alias("hour"), F.substring(x, 4, 2).cast("int").alias("minute")))


def slash_command(x: Column) -> Column:
    """(command, rest) of a text that begins with one, else null."""
    p = r"(?s)^\s*/([A-Za-z][A-Za-z0-9_-]*)\s*(.*)$"
    return F.when(x.rlike(p), F.struct(F.lower(F.regexp_extract(x, p, 1)).alias("command"), F.regexp_extract(x, p, 2).alias("rest")))


def repo_mention(x: Column) -> Column:
    """The first name that a text mentions by a number sign, else null."""
    return F.nullif(F.regexp_extract(x, r"(?:^|\s)#([^\s#]+)", 1), F.lit(""))


def find_skill(skills: DataFrame, names: DataFrame, order: str = "seq") -> DataFrame:
    """names (name) with the first skill (name, ...) of each, by name without regard to case; nulls where there is none."""
    first = skills.withColumn("__key", F.lower("name"))
    first = first.groupBy("__key").agg(F.min_by(F.struct(*skills.columns), order).alias("skill"))
    return names.withColumn("__key", F.lower("name")).join(first, "__key", "left").drop("__key")


def window_preview(windows: DataFrame, col: str = "text", size: str = "n_sentences") -> DataFrame:
    """Add char_count and sentence_count to windows of tagged sentences; ``size``: a column with the number, where there is one."""
    count = F.col(size).cast("long") if size in windows.columns else F.regexp_count(col, F.lit(r"(?m)^\[\[[^\]]+\]\]")).cast("long")
    return windows.withColumns({"char_count": F.length(col).cast("long"), "sentence_count": count})


def repeated_lines(windows: DataFrame, col: str, longest: int = 80) -> DataFrame:
    """Add ``repeats``: short lines of a window that an earlier window of its document has too. Needs doc_id, window_idx."""
    lines = F.filter(F.transform(F.split(col, "\n"), lambda s: F.lower(F.trim(s))), lambda s: (s != "") & (F.length(s) <= longest))
    e = windows.select("doc_id", "window_idx", F.explode(F.array_distinct(lines)).alias("line"))
    first = e.withColumn("first", F.min("window_idx").over(W.partitionBy("doc_id", "line")))
    n = first.where("window_idx > first").groupBy("doc_id", "window_idx").agg(F.count("*").alias("repeats"))
    return windows.join(n, ["doc_id", "window_idx"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0).cast("long")))


def render_edges(edges: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """One text for each group: a line for each edge, by its ends' labels."""
    e = graph.edge_labels(edges, nodes).withColumn("line", F.format_string("%s -[%s]-> %s", "src_label", "relation", "dst_label"))
    return e.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))


def next_after_run(once: Column, planned: Column, now: Column) -> Column:
    """(next, enabled): a one-off is done, and a planned time must lie ahead."""
    ahead = ~once & planned.isNotNull() & (planned > now)
    return F.struct(F.when(ahead, planned).alias("next"), ahead.alias("enabled"))


def lesson_score(task: Column, triggers: Column, origin: Column | None = None, host: Column | None = None) -> Column:
    """Four if the lesson comes from the active host or a domain above it; two for each trigger in the task, else its long terms that the task has."""
    clean = F.filter(F.transform(triggers, lambda t: F.lower(TX.squeeze_ends(t))), lambda t: t != "")
    has = TX.long_terms(task)
    each = lambda t: F.when(F.contains(F.lower(task), t), 2).otherwise(F.size(F.filter(F.filter(TX.tokens(t), lambda x: F.length(x) > 2), lambda x: F.array_contains(has, x))))
    score = F.aggregate(F.transform(clean, each), F.lit(0), lambda s, x: s + x)
    if origin is not None and host is not None:
        near = (origin != "") & (host != "") & ((host == origin) | host.endswith(F.concat(F.lit("."), origin)))
        score = score + F.when(near, 4).otherwise(0)
    return score


def relevant_lessons(lessons: DataFrame, task: str, host: str = "", n: int = 3) -> DataFrame:
    """The n lessons of positive score, then the most used. lessons: id, triggers, origin, uses."""
    score = lesson_score(F.lit(task), F.col("triggers"), F.coalesce("origin", F.lit("")), F.lit(host))
    return lessons.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc(F.coalesce("uses", F.lit(0))), "id").limit(n)


def similar_lessons(lessons: DataFrame, text: str, triggers: list[str], origin: str | None = None) -> DataFrame:
    """Lessons that a new one repeats: the same origin with a trigger in common, or half its long terms (two to four) shared."""
    new = TX.long_terms(F.lit(" ".join([text, *triggers])))
    known = F.array(*[F.lit(t) for t in triggers]).cast("array<string>")
    same = (F.col("origin") != "") & (F.col("origin") == F.lit(origin)) & F.exists("triggers", lambda t: F.array_contains(known, F.lower(t)))
    shared = TX.overlap(new, TX.long_terms(F.concat_ws(" ", "text", F.array_join("triggers", " "))))
    enough = F.least(F.lit(4), F.greatest(F.lit(2), F.ceil(F.size(new) / 2)))
    return lessons.where(F.coalesce(same, F.lit(False)) | (shared >= enough))


def first_incompatibility(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the first (pattern, reason) that matches, else null."""
    out = None
    for pattern, reason in rules:
        out = F.when(text.rlike(pattern), reason) if out is None else out.when(text.rlike(pattern), reason)
    return out


def one_of(x: Column, allowed: list[str], default: str) -> Column:
    return F.when(x.isin(allowed), x).otherwise(F.lit(default))


def map_label(x: Column, names: dict[str, str], default: str) -> Column:
    """A label by its mapped name."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[x], F.lit(default)) if names else F.lit(default)


def within_limits(started: Column, now: Column, minutes: Column, sources: Column, most: Column) -> Column:
    """null within the limits, else which is reached first: time, then sources."""
    spent = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 60_000_000
    return F.when(spent >= minutes, "time").when(sources >= most, "sources")
