"""Queries for the operators around retrieval, graphs, records and texts, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import assist, chunking, graph, memory, parsing, records, retrieval, search_calls
from ..session import dealt, table
from ..sources import search
from .queries import _FNV, QUERY, _bm25_sql, _index, _POST, query

_BM25 = f"{_POST}, {_bm25_sql('b', QUERY)}"
_QUANTISED = """u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT d, CASE WHEN max(abs(x)) > 0 THEN max(abs(x)) ELSE 1 END AS m FROM u GROUP BY d),
z AS (SELECT vec_id, list(greatest(-127, least(127, floor(x / m * 127 + 0.5))) ORDER BY d) AS q, list(m ORDER BY d) AS scale FROM u JOIN s USING (d) GROUP BY vec_id)"""
_T = "'[a-z0-9][a-z0-9._-]*'"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {_T})"


def _array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- a graph of parts: nodes, edges between parts of one order, communities of a size

ASK = "gear plate returned promo steel"
_G = """nodes AS (SELECT p_partkey AS id, p_partkey AS seq, p_name AS label, p_type AS type, [p_brand, p_name || ' ' || p_size] AS aliases, 'A ' || p_type || ' of size ' || p_size AS summary, ['s' || p_partkey % 300, 's' || p_partkey % 7] AS evidence FROM part),
edges AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS seq, l_partkey AS src, l_partkey * 7 % 150 + 1 AS dst, CASE l_returnflag WHEN 'R' THEN 'returned with' WHEN 'A' THEN 'sold with' ELSE 'near' END AS relation, ['s' || l_orderkey % 300] AS evidence FROM lineitem WHERE l_orderkey % 40 = 0),
communities AS (SELECT 'c' || p_size AS id, p_size AS seq, 'Parts of size ' || p_size AS title, 'Such as ' || min(p_name) AS summary, list(p_partkey ORDER BY p_partkey) AS node_ids, ['s' || p_size, 's' || p_size + 100] AS evidence FROM part GROUP BY p_size)"""


def _parts(spark, sf) -> search_calls.StoredGraph:
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem").where("l_orderkey % 40 = 0")
    nodes = p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("label"), F.col("p_type").alias("type"),
        F.array("p_brand", F.concat_ws(" ", "p_name", "p_size")).alias("aliases"), F.concat(F.lit("A "), "p_type", F.lit(" of size "), "p_size").alias("summary"),
        F.array(F.concat(F.lit("s"), p.p_partkey % 300), F.concat(F.lit("s"), p.p_partkey % 7)).alias("evidence"),
    )
    key = (l.l_orderkey * 10 + l.l_linenumber).cast("long")
    relation = F.when(l.l_returnflag == "R", "returned with").when(l.l_returnflag == "A", "sold with").otherwise("near")
    edges = l.select(
        key.alias("id"), key.alias("seq"), F.col("l_partkey").alias("src"), (l.l_partkey * 7 % 150 + 1).alias("dst"), relation.alias("relation"),
        F.array(F.concat(F.lit("s"), l.l_orderkey % 300)).alias("evidence"),
    )
    groups = p.groupBy("p_size").agg(F.min("p_name").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("node_ids"))
    communities = groups.select(
        F.concat(F.lit("c"), "p_size").alias("id"), F.col("p_size").alias("seq"), F.concat(F.lit("Parts of size "), "p_size").alias("title"), F.concat(F.lit("Such as "), "n").alias("summary"),
        "node_ids", F.array(F.concat(F.lit("s"), "p_size"), F.concat(F.lit("s"), F.col("p_size") + 100)).alias("evidence"),
    )
    return search_calls.StoredGraph(nodes, edges, communities)


def _ov(x: str, q: str = ASK) -> str:
    return f"len(list_intersect(list_distinct({_tok(x)}), {_array(q.split())}))"


def _said(x: str) -> str:
    return f"(trim({x}) <> '' AND contains('{ASK}', lower(trim({x}))))::INT"


_REL = f"""rel AS (SELECT *, (4 * {_ov('label')} + 8 * {_said('label')} + 3 * {_ov('aliases[1]')} + 7 * {_said('aliases[1]')} + 3 * {_ov('aliases[2]')} + 7 * {_said('aliases[2]')} + {_ov('summary')} + {_ov('type')})::DOUBLE AS rel FROM nodes)"""


@query(f"WITH {_G}, {_REL} SELECT id, rel FROM rel WHERE rel > 0")
def node_relevance(spark, sf):
    return _parts(spark, sf).nodes.select("id", graph.node_relevance(ASK).cast("double").alias("rel")).where("rel > 0")


_EVIDENCE = f"""{_G}, {_REL}, seeds AS (SELECT * FROM rel WHERE rel > 0 ORDER BY rel DESC, seq LIMIT 8),
own AS (SELECT 10 + 4 * rel AS score, unnest(evidence) AS evidence FROM seeds),
near AS (SELECT e.*, s.id AS seed, 3 * {_ov('e.relation')} + {_ov("coalesce(a.label, '')")} + {_ov("coalesce(b.label, '')")} AS o FROM edges e JOIN seeds s ON s.id IN (e.src, e.dst) LEFT JOIN nodes a ON a.id = e.src LEFT JOIN nodes b ON b.id = e.dst),
chosen AS (SELECT DISTINCT id, src, dst, relation, evidence FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY o DESC, seq) AS k FROM near) WHERE k <= 5),
scored AS (SELECT c.*, greatest(coalesce(a.rel, 0), coalesce(b.rel, 0)) AS a, {_ov('c.relation')} AS m, a.id IS NULL AS out_src, b.id IS NULL AS out_dst FROM chosen c LEFT JOIN seeds a ON a.id = c.src LEFT JOIN seeds b ON b.id = c.dst),
via AS (SELECT 8 + 2 * a + 3 * m AS score, unnest(evidence) AS evidence FROM scored),
others AS (SELECT 3 + a + m AS score, unnest(n.evidence) AS evidence FROM (SELECT a, m, src AS node FROM scored WHERE out_src UNION ALL SELECT a, m, dst FROM scored WHERE out_dst) o JOIN nodes n ON n.id = o.node),
coms AS (SELECT 4 + 2 * l + s AS score, unnest(evidence) AS evidence FROM (SELECT *, {_ov("title || ' ' || summary")} AS l, (SELECT count(*) FROM seeds WHERE list_contains(c.node_ids, seeds.id)) AS s FROM communities c) WHERE l > 0 OR s > 0),
evidence AS (SELECT evidence, sum(score)::DOUBLE AS score FROM (FROM own UNION ALL FROM via UNION ALL FROM others UNION ALL FROM coms) GROUP BY evidence)"""


@query(f"WITH {_EVIDENCE} SELECT evidence, score FROM evidence")
def graph_evidence(spark, sf):
    """What seeds, their best edges, those edges' other ends, and communities cite."""
    g = _parts(spark, sf)
    return graph.graph_evidence(g.nodes, g.edges, g.communities, ASK)


@query(f"""WITH {_EVIDENCE}, f AS (SELECT 's' || i AS evidence, min(i // 3) AS item FROM range(0, 200) t(i) GROUP BY ALL UNION ALL SELECT 's1', 90), g AS (SELECT evidence, min(item) AS item FROM f GROUP BY evidence),
c AS (SELECT item, sum(score) AS score FROM evidence JOIN g USING (evidence) GROUP BY item) SELECT item, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM c QUALIFY rank <= 50""")
def graph_chunks(spark, sf):
    """Chunks of three sentences each by that evidence; one sentence is in two, some are in none."""
    g = _parts(spark, sf)
    s = spark.range(200).select(F.concat(F.lit("s"), "id").alias("sentence_id"), F.floor(F.col("id") / 3).alias("item"))
    s = s.unionByName(spark.range(1).select(F.lit("s1").alias("sentence_id"), F.lit(90).cast("long").alias("item")))
    return graph.graph_chunks(graph.graph_evidence(g.nodes, g.edges, g.communities, ASK), s)


_RANKED = f"""{_G}, n AS (SELECT id, 3 * {_ov('label')} + 2 * {_ov("aliases[1] || ' ' || aliases[2]")} + {_ov('summary')} + {_ov('type')} AS w FROM nodes),
m AS (SELECT id, unnest(node_ids) AS node FROM communities), inside AS (SELECT a.id, 2 * {_ov('e.relation')} AS w FROM edges e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst AND b.id = a.id),
t AS (SELECT id, sum(w)::BIGINT AS score FROM (SELECT id, 4 * {_ov('title')} + {_ov('summary')} AS w FROM communities UNION ALL SELECT m.id, n.w FROM m JOIN n ON n.id = m.node UNION ALL FROM inside) GROUP BY id),
ranked AS (SELECT c.id, c.title, t.score, c.evidence FROM communities c JOIN t USING (id) WHERE t.score > 0 ORDER BY t.score DESC, c.seq LIMIT 5)"""


@query(f"WITH {_RANKED} SELECT id, title, score FROM ranked")
def community_ranks(spark, sf):
    g = _parts(spark, sf)
    return assist.community_rank(g.communities, ASK, 5, g.nodes, g.edges).select("id", "title", "score")


@query(f"""WITH {_RANKED}, d AS (SELECT 's' || doc_id AS sentence_id, doc_id AS item, left(text, 20) AS text FROM documents), x AS (SELECT id, unnest(evidence) AS s, generate_subscripts(evidence, 1) AS k FROM ranked)
SELECT r.id, r.title, (SELECT string_agg(sentence_id || '=' || item || '=' || text, '|' ORDER BY k) FROM x JOIN d ON x.s = d.sentence_id WHERE x.id = r.id) AS citations FROM ranked r""")
def global_search(spark, sf):
    """The themes nearest to a query with what they cite; documents stand for sentences."""
    g = _parts(spark, sf)
    out = search_calls.global_search(g, _sentences(spark, sf), ASK)
    return out.select("id", "title", _told("citations"))


def _sentences(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("s"), "doc_id").alias("sentence_id"), F.col("doc_id").alias("item"), F.substring("text", 1, 20).alias("text"))


def _told(col: str):
    return F.nullif(F.array_join(F.transform(col, lambda x: F.concat_ws("=", x.sentence_id, x["item"], x.text)), "|"), F.lit("")).alias(col)


_SUB = f"""{_G}, q AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(label || ' ' || aliases[1] || ' ' || aliases[2] || ' ' || summary), '[a-z0-9][a-z0-9.-]*')), {_array(ASK.split())})) AS score FROM nodes),
seeds AS (SELECT * FROM q WHERE score > 0 ORDER BY score DESC, id LIMIT 8)"""


@query(f"""WITH {_SUB}, d AS (SELECT 's' || doc_id AS sentence_id, doc_id AS item, left(text, 20) AS text FROM documents), x AS (SELECT id, unnest(evidence) AS s, generate_subscripts(evidence, 1) AS k FROM seeds)
SELECT s.id, s.label, s.score::BIGINT AS score, (SELECT string_agg(sentence_id || '=' || item || '=' || text, '|' ORDER BY k) FROM x JOIN d ON x.s = d.sentence_id WHERE x.id = s.id) AS citations FROM seeds s""")
def graph_search_entities(spark, sf):
    nodes, _ = search_calls.search_graph(_parts(spark, sf), _sentences(spark, sf), ASK)
    return nodes.select("id", "label", F.col("score").cast("long").alias("score"), _told("citations"))


@query(f"""WITH {_SUB} SELECT e.id, coalesce(a.label, '?') AS src_label, e.relation, coalesce(b.label, '?') AS dst_label FROM edges e LEFT JOIN nodes a ON a.id = e.src LEFT JOIN nodes b ON b.id = e.dst
WHERE e.src IN (SELECT id FROM seeds) OR e.dst IN (SELECT id FROM seeds)""")
def graph_search_relations(spark, sf):
    _, edges = search_calls.search_graph(_parts(spark, sf), _sentences(spark, sf), ASK)
    return edges.select("id", "src_label", "relation", "dst_label")


@query(f"WITH {_SUB} SELECT id, src, dst FROM edges WHERE src IN (SELECT id FROM seeds) AND dst IN (SELECT id FROM nodes WHERE id % 3 = 0) UNION SELECT id, src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE id % 3 = 0) AND dst IN (SELECT id FROM nodes WHERE id % 3 = 0)")
def induced_edges(spark, sf):
    """Edges inside every third node, and from the seeds of a query into it."""
    g = _parts(spark, sf)
    third = g.nodes.where("id % 3 = 0").select("id")
    seeds, _ = graph.subgraph(g.nodes, g.edges, ASK)
    into = g.edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").join(third.select(F.col("id").alias("dst")), "dst", "left_semi")
    return graph.induced(g.edges, third).select("id", "src", "dst").unionByName(into.select("id", "src", "dst")).distinct()


@query(f"WITH {_G} SELECT src, relation, dst, count(*) AS weight, min(seq) AS seq, list_distinct(list(evidence[1] ORDER BY seq))::VARCHAR IS NOT NULL AS cited FROM edges GROUP BY src, relation, dst")
def merged_edges(spark, sf):
    e = graph.merge_edges(_parts(spark, sf).edges)
    return e.select("src", "relation", "dst", "weight", "seq", (F.size("evidence") > 0).alias("cited"))


@query(f"""WITH {_G}, r AS (SELECT CASE WHEN src % 5 = 0 THEN src - 5 ELSE src END AS src, relation, CASE WHEN dst % 5 = 0 THEN dst - 5 ELSE dst END AS dst, seq FROM edges)
SELECT src, relation, dst, count(*) AS weight, min(seq) AS seq FROM r WHERE src <> dst GROUP BY ALL""")
def redirected_edges(spark, sf):
    """Every fifth node goes into another."""
    g = _parts(spark, sf)
    ids = g.nodes.select("id").unionByName(g.edges.select(F.col("dst").alias("id"))).distinct()
    into = ids.where("id % 5 = 0").select("id", (F.col("id") - 5).alias("into"))
    return graph.redirect(g.edges, into).select("src", "relation", "dst", "weight", "seq")


_NAMED = """n AS (SELECT p_partkey AS seq, trim(regexp_replace(lower(p_brand), '\\s+', ' ', 'g')) AS key, p_brand AS label, p_type AS type, 'd' || p_partkey % 40 AS doc, 'e' || p_partkey % 90 AS ev, p_name AS summary FROM part)"""


@query(rf"""WITH {_NAMED}, d AS (SELECT key, doc, min(seq) AS s, row_number() OVER (PARTITION BY key ORDER BY min(seq)) AS k FROM n GROUP BY key, doc), e AS (SELECT key, ev, row_number() OVER (PARTITION BY key ORDER BY min(seq)) AS k FROM n GROUP BY key, ev)
SELECT 'n_' || {_FNV.replace('text', 'key')} AS id, arg_min(label, seq) AS label, arg_min(type, seq) AS type, (SELECT string_agg(doc, ' ' ORDER BY k) FROM d WHERE d.key = n.key AND k <= 200) AS docs, (SELECT string_agg(ev, ' ' ORDER BY k) FROM e WHERE e.key = n.key AND k <= 50) AS evidence,
arg_min(summary, (-length(summary))::BIGINT * 1000000 + seq) AS summary FROM n GROUP BY key""")
def merged_nodes(spark, sf):
    """Parts of a brand as one entity: united evidence and documents under their caps, the longest summary."""
    p = table(spark, sf, "part")
    n = p.select(
        F.col("p_partkey").alias("seq"), F.lit("x").alias("id"), F.col("p_brand").alias("label"), F.col("p_type").alias("type"), F.array(F.concat(F.lit("e"), p.p_partkey % 90)).alias("evidence"),
        F.array(F.concat(F.lit("d"), p.p_partkey % 40)).alias("doc_ids"), F.array().cast("array<string>").alias("aliases"), F.col("p_name").alias("summary"),
    )
    return graph.merge_nodes(n).select("id", "label", "type", F.array_join("doc_ids", " ").alias("docs"), F.array_join("evidence", " ").alias("evidence"), "summary")


@query(r"""WITH n AS (SELECT p_partkey AS id, unnest([p_name, p_brand || ' ' || p_size]) AS name FROM part), k AS (SELECT trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS key, arg_max(id, id) AS id FROM n GROUP BY 1)
SELECT p_partkey, coalesce(k.id, -1) AS id FROM part LEFT JOIN k ON k.key = trim(regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_name) WHEN 1 THEN p_brand || '  ' || p_size ELSE 'nothing ' || p_name END), '\s+', ' ', 'g'))""")
def resolved_labels(spark, sf):
    """Labels and aliases in other case and spacing; the later node wins, unknown ones have none."""
    p = table(spark, sf, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("label"), F.array(F.concat_ws(" ", "p_brand", "p_size")).alias("aliases"))
    said = F.when(p.p_partkey % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"))).when(p.p_partkey % 3 == 1, F.concat_ws("  ", "p_brand", "p_size")).otherwise(F.concat(F.lit("nothing "), "p_name"))
    return graph.resolve_labels(nodes, p.select("p_partkey", said.alias("label"))).select("p_partkey", F.coalesce("id", F.lit(-1).cast("long")).alias("id"))


@query(f"""WITH {_G}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), top AS (SELECT n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) ORDER BY degree DESC, id LIMIT 30)
SELECT id, src, dst FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)""")
def top_entity_edges(spark, sf):
    """Edges among the thirty entities of highest degree."""
    g = _parts(spark, sf)
    return graph.induced(g.edges, graph.top_entities(g.nodes, g.edges, 30)).select("id", "src", "dst")


@query(f"WITH {_G} SELECT id FROM edges WHERE src % 11 <> 0 AND dst % 11 <> 0")
def cascaded_edges(spark, sf):
    """Edges left when every eleventh memory goes."""
    g = _parts(spark, sf)
    gone = g.nodes.select("id").unionByName(g.edges.select(F.col("dst").alias("id"))).where("id % 11 = 0").distinct()
    return memory.cascade_delete(g.nodes, g.edges, gone)[1].select("id")


@query("""WITH e AS (SELECT user_id AS conv, event_id, event_type, event_id % 4 AS src, event_id % 5 AS dst FROM events WHERE event_id < 400)
SELECT conv, string_agg(line, E'\n' ORDER BY line) AS text FROM (SELECT conv, CASE WHEN src < 3 THEN 'n' || src ELSE '?' END || ' -[' || event_type || ']-> ' || CASE WHEN dst < 3 THEN 'n' || dst ELSE '?' END AS line FROM e) GROUP BY conv""")
def rendered_edges(spark, sf):
    """Relations as lines; an end without a node is unknown."""
    e = table(spark, sf, "events").where("event_id < 400")
    edges = e.select(F.col("user_id").alias("conv"), F.col("event_type").alias("relation"), (F.col("event_id") % 4).alias("src"), (F.col("event_id") % 5).alias("dst"))
    nodes = spark.range(3).select("id", F.concat(F.lit("n"), "id").alias("label"))
    return assist.render_edges(edges, nodes, ["conv"])


# ---- retrieval

@query(f"WITH {_QUANTISED} SELECT vec_id, round(list_sum(list_transform(list_zip(q, scale), lambda x: x[1] * x[2] / 127)), 6) AS total FROM z")
def dequantized_vectors(spark, sf):
    """Sums of the components that quantised vectors stand for."""
    e = table(spark, sf, "embeddings")
    q = e.crossJoin(F.broadcast(retrieval.scale_array(retrieval.calibrate(e, "embedding"))))  # one row
    v = V.dequantize(V.quantize(F.col("embedding"), F.col("scale")), F.col("scale"))
    return q.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@query(f"""WITH {_QUANTISED}, a AS (SELECT q AS aq FROM z WHERE vec_id = 7) SELECT vec_id, round(list_sum(list_transform(list_zip(q, aq, scale), lambda x: x[1] * (x[2] * x[3] * x[3]))) / 16129, 6) AS score FROM z, a""")
def quantised_search(spark, sf):
    """Scores of all quantised vectors with a quantised query."""
    e = table(spark, sf, "embeddings")
    z = e.crossJoin(F.broadcast(retrieval.scale_array(retrieval.calibrate(e, "embedding")))).select("vec_id", "scale", V.quantize(F.col("embedding"), F.col("scale")).alias("q"))  # one row
    one = z.where("vec_id = 7").select(F.col("q").alias("aq"))
    return z.crossJoin(F.broadcast(one)).select("vec_id", F.round(V.score_quantized(F.col("q"), F.col("aq"), F.col("scale")), 6).alias("score"))  # one row


_PLANES = "[" + ", ".join(str([float(x) for x in p]) for p in graph.lsh_planes(64, 7)) + "]"


@query(f"""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(list_transform(range(1, 8), lambda b: CASE WHEN list_dot_product(embedding::DOUBLE[], ({_PLANES})[b]::DOUBLE[]) >= 0 THEN 1 << (b - 1) ELSE 0 END))::BIGINT AS sig FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM s a JOIN s b ON a.vec_id < b.vec_id AND bit_count(xor(a.sig, b.sig)) <= 1 WHERE list_cosine_similarity(a.v, b.v) >= 0.3""")
def bucketed_neighbours(spark, sf):
    """Pairs of cosine 0.3 in one bucket of seven planes or in buckets one bit apart."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.bucketed_pairs(v, 7, 64, 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""WITH c AS (SELECT user_id AS id, list(DISTINCT event_id % 40 ORDER BY event_id % 40)[1:5] AS relevant FROM events GROUP BY user_id), r AS (SELECT user_id AS id, list(event_id % 60 ORDER BY event_id)[1:12] AS ranking FROM events WHERE user_id % 4 > 0 GROUP BY user_id),
j AS (SELECT c.id, relevant, coalesce(ranking, []) AS ranking FROM c LEFT JOIN r USING (id)),
s AS (SELECT len(list_intersect(list_distinct(ranking[1:5]), relevant)) AS hits, len(relevant) AS n, list_min(list_filter(list_transform(relevant, lambda x: list_position(ranking, x)), lambda p: p > 0)) AS first, len(list_filter(ranking, lambda i: i >= 50)) AS bad FROM j)
SELECT round(avg(hits / n), 6) AS recall, round(avg((hits > 0)::INT), 6) AS hit, round(avg(coalesce(1 / first, 0)), 6) AS mrr, sum(bad)::BIGINT AS invalid FROM s""")
def retrieval_evaluation(spark, sf):
    """Rankings against what is relevant; some users have no ranking, some references are out of range."""
    e = table(spark, sf, "events")
    cases = e.groupBy(F.col("user_id").alias("id")).agg(F.slice(F.sort_array(F.collect_set(F.col("event_id") % 40)), 1, 5).alias("relevant")).withColumn("n_items", F.lit(50))
    listed = F.transform(F.slice(F.array_sort(F.collect_list("event_id")), 1, 12), lambda x: x % 60)
    r = retrieval.evaluate(cases, e.where("user_id % 4 > 0").groupBy(F.col("user_id").alias("id")).agg(listed.alias("ranking")), 5)
    return r.select(F.round("recall", 6).alias("recall"), F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"), "invalid")


@query(f"""WITH {_BM25}, h AS (SELECT item, row_number() OVER (ORDER BY score DESC, item) AS rank FROM b QUALIFY rank <= 6), terms AS (SELECT list_filter(list_distinct(regexp_extract_all('the license of the inth and thion', {_T})), lambda x: length(x) > 2 AND x NOT IN ({', '.join(f"'{w}'" for w in retrieval.QUERY_STOPWORDS)})) AS q),
c AS (SELECT len(list_intersect(list_distinct({_tok('text')}), q)) / len(q) AS share, source FROM h JOIN documents ON doc_id = item, terms)
SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN max(share) >= 0.3 THEN 'strong' ELSE 'weak' END AS level, round(max(share), 6) AS coverage, count(DISTINCT source) AS sources FROM c""")
def retrieval_confidence(spark, sf):
    """How well the best hits cover a query that the graph supports."""
    docs = table(spark, sf, "documents")
    hits = retrieval.top(_index(spark, sf).search(QUERY), 20).join(docs, F.col("item") == F.col("doc_id"))
    c = retrieval.confidence(hits.select("rank", "text", F.lit("").alias("url"), F.col("source").alias("name")), QUERY, True)
    return c.select("level", F.round("coverage", 6).alias("coverage"), "sources")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k % (n // 37) = 0 AND k // (n // 37) < 37")
def strided_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return chunking.strided(o, o.count(), 37, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), i AS (SELECT conv_id, n, unnest(range(0, 3)) AS i FROM n)
SELECT c.conv_id, c.turn FROM conversations c JOIN n USING (conv_id) WHERE n <= 3 OR c.turn IN (SELECT floor(i * (n - 1) / 2 + 0.5) FROM i WHERE i.conv_id = c.conv_id)""")
def evenly_sampled(spark, sf):
    """Three turns of each conversation, both ends included."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = [r.n for r in n.select("n").distinct().collect()]  # lengths of conversations: a few numbers
    places = F.create_map(*[y for s in sizes for y in (F.lit(s), F.array(*[F.lit(i) for i in chunking.evenly(s, 3)]))])
    return c.join(n, "conv_id").where(F.array_contains(places[F.col("n")], F.col("turn").cast("int"))).select("conv_id", "turn")


@query("""SELECT conv_id AS doc_id, turn AS sentence_idx, coalesce(lag(text, 2) OVER w || ' ' || lag(text) OVER w, lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def sentence_context(spark, sf):
    """Two turns before and one after each."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.col("turn").alias("sentence_idx"), "text")
    return chunking.with_context(c, 2, 1).select("doc_id", "sentence_idx", "before", "after")


_BIO = """t AS (SELECT l_orderkey AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_returnflag AS f, l_discount AS s, l_partkey % 3 = 0 AS b FROM lineitem),
u AS (SELECT *, CASE f WHEN 'A' THEN 'PER' WHEN 'N' THEN 'LOC' ELSE '' END AS label FROM t), v AS (SELECT *, label <> coalesce(lag(label) OVER x, '') OR (b AND label <> '') AS fresh FROM u WINDOW x AS (PARTITION BY w ORDER BY pos)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY w ORDER BY pos) AS run FROM v), spans AS (SELECT w AS window_id, label, min(pos * 10) AS start, max(pos * 10 + 6) AS "end", round(avg(s), 6) AS score FROM r WHERE label <> '' GROUP BY w, run, label)"""


def _bio(spark, sf):
    from pyspark.sql import Window as W

    l = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount"), "l_orderkey")
    t = l.withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long"))
    kind = F.when(t.l_returnflag == "A", "PER").when(t.l_returnflag == "N", "LOC")
    tag = F.when(kind.isNull(), "O").otherwise(F.concat(F.when(t.l_partkey % 3 == 0, "B-").otherwise("I-"), kind))
    t = t.select(F.col("l_orderkey").alias("window_id"), "pos", tag.alias("tag"), (t.pos * 10).alias("start"), (t.pos * 10 + 6).alias("end"), F.col("l_discount").alias("score"))
    return chunking.bio_spans(t)


@query(f'WITH {_BIO} SELECT window_id, label, start, "end", score FROM spans')
def bio_spans(spark, sf):
    """Runs of one label in the lines of each order."""
    return _bio(spark, sf).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BIO}, s AS (SELECT DISTINCT l_orderkey AS window_id, i AS sentence_idx, i * 25 AS a, i * 25 + 20 AS b FROM lineitem, range(0, 4) t(i)),
j AS (SELECT p.window_id, p.label, p.start, p."end", s.sentence_idx, row_number() OVER (PARTITION BY p.window_id, p.start, p."end", p.label ORDER BY (p.start >= a AND p.start < b) DESC, sentence_idx) AS k FROM spans p LEFT JOIN s ON s.window_id = p.window_id AND ((p.start >= a AND p.start < b) OR (p."end" - 1 >= a AND p."end" - 1 < b)))
SELECT window_id, label, start, "end", coalesce(sentence_idx, -1) AS sentence_idx FROM j WHERE k = 1""")
def spans_in_sentences(spark, sf):
    """The sentence of each span; some lie between two."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("window_id")).distinct().crossJoin(spark.range(4))  # four rows
    s = s.select("window_id", F.col("id").alias("sentence_idx"), (F.col("id") * 25).alias("start"), (F.col("id") * 25 + 20).alias("end"))
    return chunking.spans_in_sentences(_bio(spark, sf), s).select("window_id", "label", "start", "end", F.coalesce("sentence_idx", F.lit(-1).cast("long")).alias("sentence_idx"))


# ---- texts

@query(rf"""SELECT p_partkey, array_to_string(list_distinct(regexp_extract_all(lower(x), '[a-z0-9][a-z0-9.-]*')), ' ') IS NOT NULL AS has, len(list_distinct(regexp_extract_all(lower(x), '[a-z0-9][a-z0-9.-]*'))) AS n_graph, len(list_distinct(list_filter({_tok('x')}, lambda t: length(t) > 2))) AS n_long,
len(list_filter(list_distinct({_tok('x')}), lambda t: t NOT IN ('promo', 'plated'))) AS n_rest, len(list_intersect(list_distinct({_tok('x')}), ['steel', 'bolt'])) AS shared, contains(lower(x), 'bolt') AS phrase FROM (SELECT p_partkey, p_name || ' ' || p_type || '_v2.1 ' || p_brand AS x FROM part)""")
def term_sets(spark, sf):
    """Terms of three kinds, without stop words, shared ones, and a phrase."""
    x = F.concat(F.concat_ws(" ", "p_name", "p_type"), F.lit("_v2.1 "), F.col("p_brand"))
    n = lambda c: F.size(c).cast("long")
    return table(spark, sf, "part").select(
        "p_partkey", F.lit(True).alias("has"), n(TX.graph_terms(x)).alias("n_graph"), n(TX.long_terms(x)).alias("n_long"), n(TX.without(TX.tokens(x), ["promo", "plated"])).alias("n_rest"),
        TX.overlap(TX.tokens(x), F.array(F.lit("steel"), F.lit("bolt"))).cast("long").alias("shared"), TX.has_phrase(x, F.lit(" BOLT ")).alias("phrase"),
    )


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, text FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 200 THEN left(t, 200) || '…' ELSE t END AS snippet, left(text, 90) AS head, length(text) AS chars, length(text) > 90 AS cut FROM c""")
def snippets(spark, sf):
    c = table(spark, sf, "conversations").withColumn("s", TX.slice_to_limit("text", 90))
    return c.select("conv_id", "turn", TX.snippet("text").alias("snippet"), F.col("s.text").alias("head"), F.col("s.chars").cast("long").alias("chars"), F.col("s.truncated").alias("cut"))


_CITED = "'As in [[' || conv_id || ':c0:s' || turn || '#ab12, bad id]] and [[x' || turn || ';x' || turn || '|y]] [[]] [[' || role || ']]'"


@query(rf"""WITH t AS (SELECT conv_id, turn, {_CITED} AS x FROM conversations), g AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '\[\[([^\[\]]+)\]\]', 1)) AS g, generate_subscripts(regexp_extract_all(x, '\[\[([^\[\]]+)\]\]', 1), 1) AS a FROM t),
i AS (SELECT conv_id, turn, a, trim(unnest(regexp_split_to_array(g, '[,;|]'))) AS id, generate_subscripts(regexp_split_to_array(g, '[,;|]'), 1) AS b FROM g), f AS (SELECT conv_id, turn, id, min(a * 100 + b) AS k FROM i WHERE regexp_matches(id, '^[A-Za-z0-9:_#.-]+$') GROUP BY ALL)
SELECT conv_id, turn, string_agg(id, ' ' ORDER BY k) AS ids FROM f GROUP BY ALL""")
def cited_ids(spark, sf):
    """Safe ids in citation groups, each once, in order."""
    c = table(spark, sf, "conversations")
    x = F.concat(F.lit("As in [["), c.conv_id, F.lit(":c0:s"), c.turn, F.lit("#ab12, bad id]] and [[x"), c.turn, F.lit(";x"), c.turn, F.lit("|y]] [[]] [["), c.role, F.lit("]]"))
    return c.select("conv_id", "turn", F.array_join(TX.citation_ids(x), " ").alias("ids"))


@query(r"""WITH t AS (SELECT conv_id, turn, 'a [[k' || turn || ', z]] b [[z]] [[k1;k1]]' AS x FROM conversations)
SELECT conv_id || '-' || turn AS key, CASE WHEN turn IN (0, 2) THEN 'a [[k' || turn || ']] b  ' ELSE 'a  b  ' END AS text FROM t""")
def cleaned_citations(spark, sf):
    """Groups lose the ids that are not known, and go when none is left."""
    c = table(spark, sf, "conversations")
    df = c.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.concat(F.lit("a [[k"), c.turn, F.lit(", z]] b [[z]] [[k1;k1]]")).alias("text"))
    known = spark.createDataFrame([("k0",), ("k2",)], "id string")
    return assist.clean_citations(df, "text", known)


@query(r"""SELECT p_partkey, 'v' || p_size || '.' || p_partkey % 10 AS v, (p_size || '.' || p_partkey % 10 || '.1') AS bumped, (p_size > 25 OR (p_size = 25 AND p_partkey % 10 > 3)) AS later FROM part""")
def bumped_versions(spark, sf):
    """The next version, and which are later than 25.3."""
    p = table(spark, sf, "part")
    v = F.concat(F.lit("v"), p.p_size, F.lit("."), p.p_partkey % 10)
    return p.select("p_partkey", v.alias("v"), TX.bump_version(v).alias("bumped"), (TX.version_array(v) > TX.version_array(F.lit("25.3"))).alias("later"))


@query(r"""SELECT p_partkey, p_name AS name, p_brand AS brand, NULL::VARCHAR AS none FROM part""")
def front_matters(spark, sf):
    p = table(spark, sf, "part")
    m = TX.front_matter(F.concat(F.lit("---\nname: "), "p_name", F.lit("\nbrand:  "), "p_brand", F.lit("\nname: again\n---\nbody: no\n")))
    return p.select("p_partkey", m["name"].alias("name"), m["brand"].alias("brand"), m["body"].alias("none"))


_FILES = ["a.pdf", "b.DOCX", "mail.eml", "pic.JPG", "notes.md", "data.csv", "x.bin", "noext", "deck.pptx", "page.html"]


@query(f"SELECT p_partkey, ({_array(_FILES)})[p_partkey % 10 + 1] AS name, (['pdf', 'office', 'mail', 'image', 'text', 'text', 'image', 'text', 'office', 'text'])[p_partkey % 10 + 1] AS kind FROM part")
def file_kinds(spark, sf):
    """By extension, else by type."""
    p = table(spark, sf, "part")
    name = F.element_at(F.array(*[F.lit(f) for f in _FILES]), (p.p_partkey % 10 + 1).cast("int"))
    mime = F.when(p.p_partkey % 10 == 6, "image/png").when(p.p_partkey % 10 == 7, "text/plain").otherwise("x/y")
    return p.select("p_partkey", name.alias("name"), TX.file_kind(name, mime).alias("kind"))


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), u AS (SELECT conv_id, unnest(r) AS x, generate_subscripts(r, 1) AS k FROM t), d AS (SELECT conv_id, x, min(k) AS k FROM u GROUP BY ALL)
SELECT conv_id, string_agg(x, ' ' ORDER BY k) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS n FROM d) WHERE n <= 2 GROUP BY conv_id""")
def capped_lists(spark, sf):
    """Trimmed, not empty, each once, two at most."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit(" "), x.role)).alias("r"))
    return c.select("conv_id", F.array_join(TX.clean_list(F.concat(F.array(F.lit(" "), F.lit(None)), "r"), 2), " ").alias("roles"))


@query("SELECT event_id, event_type AS kind, user_id FROM events")
def json_objects(spark, sf):
    """An object in prose and a code fence."""
    e = table(spark, sf, "events")
    x = F.concat(F.lit('Sure:\n```json\n{"kind": "'), e.event_type, F.lit('", "user": '), e.user_id, F.lit(', "in": {"a": 1}}\n```\nDone.'))
    o = TX.json_object(x, "kind string, user long")
    return e.select("event_id", o.kind.alias("kind"), o.user.alias("user_id"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS key, 'q:' || lower(trim(regexp_replace('  Find   ' || page_id || ' ', '\s+', ' ', 'g'))) AS query_key, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
CASE WHEN regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*\.pdf([?#]|$)') THEN 'pdf' END AS kind FROM pages""")
def frontier_keys(spark, sf):
    p = table(spark, sf, "pages")
    none = F.lit(None).cast("string")
    return p.select(
        "page_id", U.frontier_key(p.url).alias("key"), U.frontier_key(none, F.concat(F.lit("  Find   "), p.page_id, F.lit(" "))).alias("query_key"), U.url_host(p.url).alias("host"), U.document_kind(p.url).alias("kind"),
    )


# ---- records

@query("""SELECT o_orderkey, CASE WHEN t ~ '^([01][0-9]|2[0-3]):[0-5][0-9]$' THEN left(t, 2)::INT * 60 + right(t, 2)::INT ELSE -1 END::BIGINT AS minutes, o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 AS ahead
FROM (SELECT o_orderkey, lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ':' || CASE WHEN o_orderkey % 5 = 0 THEN '7' ELSE lpad((o_orderkey % 70)::VARCHAR, 2, '0') END AS t FROM orders)""")
def run_times(spark, sf):
    """Strict times of day, and planned runs that lie ahead of tasks that are not done."""
    o = table(spark, sf, "orders")
    t = F.concat(F.lpad((o.o_orderkey % 30).cast("string"), 2, "0"), F.lit(":"), F.when(o.o_orderkey % 5 == 0, "7").otherwise(F.lpad((o.o_orderkey % 70).cast("string"), 2, "0")))
    local = assist.local_time(t)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    planned = F.when(o.o_orderkey % 3 == 0, F.lit("2024-03-02").cast("timestamp")).when(o.o_orderkey % 3 == 1, now)
    return o.select("o_orderkey", F.coalesce(local.hour * 60 + local.minute, F.lit(-1)).cast("long").alias("minutes"), assist.next_after_run(o.o_orderkey % 4 == 0, planned, now).enabled.alias("ahead"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS no FROM documents), l AS (SELECT DISTINCT doc_id, no // 4 AS window_idx, lower(trim(line)) AS line FROM w WHERE trim(line) <> '' AND length(trim(line)) <= 80),
f AS (SELECT *, min(window_idx) OVER (PARTITION BY doc_id, line) AS first FROM l), every AS (SELECT DISTINCT doc_id, no // 4 AS window_idx FROM w)
SELECT e.doc_id, e.window_idx, count(f.line) AS repeats FROM every e LEFT JOIN f ON f.doc_id = e.doc_id AND f.window_idx = e.window_idx AND f.window_idx > f.first GROUP BY ALL""")
def repeated_lines(spark, sf):
    """Short lines of a window of four lines that an earlier window has too."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    w = lines.groupBy("doc_id", F.floor(F.col("no") / 4).alias("window_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x.line), "\n").alias("text"))
    return assist.repeated_lines(w, "text").select("doc_id", "window_idx", "repeats")


@query("""WITH l AS (SELECT doc_id, string_split(text, E'\n') AS x FROM documents), h AS (SELECT doc_id, 0 AS half, array_to_string(x[1:((len(x) + 1) // 2)], E'\n') AS t FROM l UNION ALL SELECT doc_id, 1, array_to_string(x[((len(x) + 1) // 2 + 1):], E'\n') FROM l)
SELECT doc_id, half::BIGINT AS half, length(t) AS chars FROM h WHERE t <> ''""")
def halved_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return assist.split_window(d, "text").select("doc_id", F.col("half").cast("long").alias("half"), F.length("text").cast("long").alias("chars"))


_STATES = ["queued", "running", "paused", "done", "cancelled"]
_COMMANDS = ["start", "pause", "resume", "cancel"]


@query(f"""WITH t AS (SELECT event_id, ({_array(_STATES)})[event_id % 5 + 1] AS s, ({_array(_COMMANDS)})[user_id % 4 + 1] AS c FROM events)
SELECT event_id, CASE WHEN c = 'start' AND s IN ('queued', 'paused') THEN 'running' WHEN c = 'pause' AND s = 'running' THEN 'paused' WHEN c = 'resume' AND s = 'paused' THEN 'running' WHEN c = 'cancel' AND s IN ('queued', 'running', 'paused') THEN 'cancelled' ELSE s END AS status FROM t""")
def job_states(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    return e.select("event_id", records.job_transition(pick(_STATES, e.event_id % 5), pick(_COMMANDS, e.user_id % 4)).alias("status"))


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'blocked' WHEN page_id % 8 = 0 OR page_id % 7 = 0 OR page_id % 5 = 0 THEN 'auth_required' WHEN page_id % 4 = 0 AND page_id % 3 = 0 THEN 'auth_required' WHEN page_id % 6 = 1 THEN 'unknown' ELSE 'authenticated' END AS state FROM pages""")
def auth_states(spark, sf):
    """Blocked pages, password fields, forms, providers, texts that ask with and without a title that does, short pages."""
    p = table(spark, sf, "pages")
    i = p.page_id
    url = F.when(i % 5 == 0, "https://a.okta.com/x").otherwise("https://example.com/author/")
    title = F.when(i % 3 == 0, "Sign in").otherwise("Home")
    text = F.when(i % 4 == 0, "Please log in to go on with what you were doing on this page.").when(i % 6 == 1, "short").otherwise("Nothing here asks for anything, it is a page like any other.")
    return p.select("page_id", records.auth_state(F.when(i % 9 == 0, "blocked").otherwise("ok"), url, title, text, i % 8 == 0, i % 7 == 0).alias("state"))


@query("""WITH l AS (SELECT p_partkey AS id, [lower(p_brand), p_name] AS triggers, CASE WHEN p_size % 4 = 0 THEN 'example.org' ELSE '' END AS origin, p_size AS uses, p_name FROM part),
s AS (SELECT id, uses, CASE WHEN origin = 'example.org' THEN 4 ELSE 0 END + list_sum(list_transform(triggers, lambda t: CASE WHEN contains('fit a bolt and brand#12 gears', lower(t)) THEN 2 ELSE len(list_filter(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9._-]*'), lambda x: length(x) > 2 AND x IN ('fit', 'bolt', 'and', 'brand', 'gears'))) END)) AS score FROM l)
SELECT id, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY score DESC, uses DESC, id LIMIT 3""")
def lesson_ranks(spark, sf):
    """Lessons by their origin and triggers, ties by use."""
    p = table(spark, sf, "part")
    lessons = p.select(F.col("p_partkey").alias("id"), F.array(F.lower("p_brand"), "p_name").alias("triggers"), F.when(p.p_size % 4 == 0, "example.org").otherwise("").alias("origin"), F.col("p_size").alias("uses"))
    return assist.relevant_lessons(lessons, "Fit a bolt and Brand#12 gears", "docs.example.org").select("id", F.col("score").cast("long").alias("score"))


@query("""WITH m AS (SELECT conv_id, turn AS seq, role, CASE WHEN role IN ('assistant', 'user') THEN 'c' || turn // 2 END AS call FROM conversations), r AS (SELECT conv_id, seq, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, call FROM m)
SELECT conv_id, seq::DOUBLE AS seq, role FROM r UNION ALL SELECT conv_id, seq + 0.5, 'tool' FROM r a WHERE role = 'assistant' AND call IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE b.conv_id = a.conv_id AND b.role = 'tool' AND b.call = a.call)""")
def repaired_pairs(spark, sf):
    """A placeholder after each call without an answer."""
    c = table(spark, sf, "conversations")
    call = F.when(c.role.isin("assistant", "user"), F.concat(F.lit("c"), F.floor(c.turn / 2).cast("string")))
    m = c.select("conv_id", F.col("turn").alias("seq"), F.when(c.role == "user", "tool").otherwise(c.role).alias("role"), call.alias("call_id"), "text")
    return records.repair_pairs(m).select("conv_id", "seq", "role")


@query("""WITH a AS (SELECT DISTINCT user_id % 50 AS key, event_type AS value FROM events WHERE event_id % 2 = 0 AND event_id < 200), c AS (SELECT key, min(value) AS value FROM a GROUP BY key), i AS (SELECT user_id % 60 AS key, min(event_type) AS value FROM events WHERE event_id % 2 = 1 AND event_id < 200 GROUP BY 1)
SELECT i.key, c.value AS old, i.value AS new FROM i LEFT JOIN c USING (key) WHERE i.value IS DISTINCT FROM c.value""")
def config_changes(spark, sf):
    e = table(spark, sf, "events").where("event_id < 200")
    current = e.where("event_id % 2 = 0").groupBy((F.col("user_id") % 50).alias("key")).agg(F.min("event_type").alias("value"))
    incoming = e.where("event_id % 2 = 1").groupBy((F.col("user_id") % 60).alias("key")).agg(F.min("event_type").alias("value"))
    return records.config_diff(current, incoming)


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 4 = 0""")
def upserted_orders(spark, sf):
    """Every fourth order replaces what is there, or is new."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return records.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT page_id FROM pages WHERE regexp_replace(url, '#.*$', '') NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages WHERE page_id % 3 = 0)")
def closed_tabs(spark, sf):
    """Expected pages that are not open, whatever their fragment."""
    p = table(spark, sf, "pages")
    key = U.canonical_url(F.col("url"))
    return records.missing_by_key(p, p.where("page_id % 3 = 0"), key, key).select("page_id")


@query(r"""WITH n AS (SELECT page_id, CASE WHEN regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) ||
regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') ELSE trim(url) END AS u FROM pages)
SELECT a.page_id AS page, b.page_id AS known FROM n a JOIN n b USING (u) WHERE a.page_id % 2 = 0 AND b.page_id % 2 = 1""")
def known_urls(spark, sf):
    """New pages whose normalised address is known."""
    p = table(spark, sf, "pages")
    a, b = p.where("page_id % 2 = 0").select(F.col("page_id").alias("page"), F.col("url").alias("a")), p.where("page_id % 2 = 1").select(F.col("page_id").alias("known"), F.col("url").alias("b"))
    return records.duplicate_urls(a, b, "a", "b").select("page", "known")


@query("""SELECT lower(url) AS key, arg_min(url, page_id) AS url, min(page_id) AS pos FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(split_part(url, '?', 1)) ELSE split_part(url, '?', 1) END AS url FROM pages) GROUP BY 1""")
def merged_bookmarks(spark, sf):
    p = table(spark, sf, "pages")
    u = F.substring_index("url", "?", 1)
    m = p.select(F.when(p.page_id % 2 == 0, F.upper(u)).otherwise(u).alias("url"), F.lit("t").alias("title"), F.array(F.lit("x")).alias("tags"), F.col("page_id").alias("pos"))
    return assist.merge_bookmarks(m).select("key", "url", "pos")


@query("""SELECT count(*) AS n_findings, (SELECT string_agg(u, ' ' ORDER BY u) FROM (SELECT DISTINCT split_part(url, '?', 1) AS u FROM pages WHERE page_id % 4 > 0 AND page_id < 40)) AS sources FROM pages WHERE page_id % 4 > 0 AND page_id < 40""")
def research_summary(spark, sf):
    """Findings with a text, and the distinct addresses that they came from."""
    p = table(spark, sf, "pages").where("page_id < 40")
    f = p.select(F.when(p.page_id % 4 == 0, "  ").otherwise("found").alias("text"), F.array(F.substring_index("url", "?", 1), F.lit("ftp://x")).alias("sources"))
    return assist.research_reduce(f).select("n_findings", F.array_join("sources", " ").alias("sources"))


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS user, NULL::VARCHAR AS none FROM events WHERE event_id < 500")
def pivoted_cells(spark, sf):
    e = table(spark, sf, "events").where("event_id < 500")
    cell = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    e = e.select("event_id", F.array(cell("kind", e.event_type), cell("user", e.user_id), cell("kind", e.user_id)).alias("cells"))
    return assist.pivot_cells(e, "cells", ["kind", "user", "none"])


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0")
def unchanged_documents(spark, sf):
    """States of documents whose text is still the one that they were made of."""
    d = table(spark, sf, "documents")
    state = d.select("doc_id", F.sha2(F.when(d.doc_id % 3 == 0, "old").otherwise(d.text), 256).alias("hash"))
    return assist.reset_changed(state, d, "text").select("doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 123 AS taken FROM orders")
def taken_batch(spark, sf):
    now, later = assist.take_batch(table(spark, sf, "orders"), 123, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return now.select("o_orderkey", F.lit(True).alias("taken")).unionByName(later.select("o_orderkey", F.lit(False).alias("taken")))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'PERSON' WHEN user_id % 4 = 1 THEN 'place' ELSE 'other' END AS kind, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'grey' END AS color FROM events")
def mapped_labels(spark, sf):
    e = table(spark, sf, "events")
    tag = F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("MISC"), F.lit("ODD")), (e.user_id % 4 + 1).cast("int"))
    return e.select("event_id", assist.map_label(tag, {"PER": "PERSON", "LOC": "place"}, "other").alias("kind"), assist.one_of(e.event_type, ["click", "view"], "grey").alias("color"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'needs a shell' WHEN event_type IN ('view', 'purchase') THEN 'needs code' END AS reason, CASE WHEN epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts) >= 600000000 THEN 'time' WHEN user_id >= 100 THEN 'sources' END AS ended FROM events""")
def first_reasons(spark, sf):
    """The first rule that a text breaks, and the limit that a job reaches first."""
    e = table(spark, sf, "events")
    why = assist.first_incompatibility(F.concat(F.lit("run "), e.event_type), [("click", "needs a shell"), ("view|purchase|click", "needs code")])
    return e.select("event_id", why.alias("reason"), assist.within_limits(e.ts, F.lit("2024-01-15").cast("timestamp"), F.lit(10), e.user_id, F.lit(100)).alias("ended"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'a' || turn || '|b' ELSE 'whole' END AS data, CASE WHEN turn % 2 = 0 THEN 'sum-up' END AS command FROM conversations")
def stream_payloads(spark, sf):
    """Payloads of event streams, and commands."""
    c = table(spark, sf, "conversations")
    x = F.when(c.turn % 3 == 0, F.concat(F.lit("event: x\ndata: a"), c.turn, F.lit("\ndata:b\n"))).otherwise("whole")
    cmd = assist.slash_command(F.when(c.turn % 2 == 0, F.concat(F.lit(" /Sum-Up "), c.text)).otherwise(c.text))
    return c.select("conv_id", "turn", F.array_join(assist.event_stream(x), "|").alias("data"), cmd.command.alias("command"))


@query("SELECT id, kind, pos, title FROM (SELECT o_orderkey AS id, 'mail' AS kind, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos, o_orderpriority AS title FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderdate >= TIMESTAMP '1995-01-01' QUALIFY pos <= 12) UNION ALL (SELECT p_partkey, 'file', row_number() OVER (ORDER BY p_size DESC, p_partkey), p_name || '.pdf' FROM part WHERE contains(lower(p_name || '.pdf ' || p_brand), 'bolt') QUALIFY row_number() OVER (ORDER BY p_size DESC, p_partkey) <= 12)")
def fanned_search(spark, sf):
    """Mail and files side by side."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    mail = o.select(F.col("o_orderkey").alias("id"), F.lit("x").alias("sender"), F.col("o_orderpriority").alias("subject"), F.col("o_orderdate").cast("timestamp").alias("received"))
    start = F.lit("2000-01-01").cast("timestamp")
    files = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".pdf")).alias("name"), F.col("p_brand").alias("path"), F.timestamp_add("DAY", F.col("p_size"), start).alias("mtime"))
    return search.fan_out(mail, files, search.mail_filter(subject="High", since="1995-01-01"), search.file_filter("bolt", kinds=[".pdf"]), 12).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-01' AND o_orderdate + INTERVAL 1 HOUR > TIMESTAMP '1996-02-01' AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'urgent') ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def calendar_range(spark, sf):
    o = table(spark, sf, "orders")
    start = o.o_orderdate.cast("timestamp")
    e = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("place"), F.lit("").alias("people"), start.alias("start"), F.timestamp_add("HOUR", F.lit(1), start).alias("end"))
    return search.calendar_search(e, "1996-02-01", "1996-03-01", "URGENT", 500).select("id")


@query("""SELECT event_id, user_id % 3 = 0 OR event_type = 'click' AS shown, (ts IS NOT NULL AND epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts) < 3600000000) AS cooling, epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts) > 86400000000 AS stale,
event_type NOT IN ('click', 'purchase') OR user_id % 2 = 0 AS allowed FROM events""")
def visibility(spark, sf):
    """What a project sees, what cools down, what is stale, and which sources are allowed."""
    e = table(spark, sf, "events")
    now = F.lit("2024-01-10").cast("timestamp")
    seen = records.visible_to(F.when(e.user_id % 3 != 0, e.event_type), F.lit("click"))
    return e.select(
        "event_id", seen.alias("shown"), records.in_cooldown(e.ts, now).alias("cooling"), parsing.older_than(e.ts, now, 86400).alias("stale"),
        parsing.source_allowed(e.event_type, ["click", "purchase"], F.lit(True), e.user_id % 2 == 0).alias("allowed"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'memory:' || user_id END AS url, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS node FROM events")
def memory_urls(spark, sf):
    e = table(spark, sf, "events")
    u = F.when(e.event_id % 3 == 0, parsing.memory_url(e.user_id.cast("string"), "memory:")).otherwise("https://x/")
    return e.select("event_id", F.when(e.event_id % 3 == 0, u).alias("url"), parsing.memory_id(u, "memory:").alias("node"))


@query("""SELECT event_id, event_type || ' kept' AS lesson, 2 AS n_triggers, user_id % 2 = 0 AS revise FROM events WHERE user_id % 3 = 0""")
def parsed_replies(spark, sf):
    """Lessons and verdicts of replies, fenced and bare; too little confidence is no lesson."""
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"lesson": " '), e.event_type, F.lit('  kept ", "triggers": ["A", " ", "b "], "confidence": '), F.when(e.user_id % 3 == 0, "0.7").otherwise("0.69"), F.lit("}"))
    lesson = parsing.lesson(F.when(e.event_id % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body))
    verdict = parsing.verdict(F.when(e.user_id % 2 == 0, '{"verdict": " Revise ", "issues": "x"}').otherwise("cannot say"))
    return e.select("event_id", lesson.alias("l"), verdict.alias("v")).where("l is not null").select("event_id", "l.lesson", F.size("l.triggers").alias("n_triggers"), "v.revise")


@query(r"""SELECT p_partkey, left(trim(regexp_replace(regexp_replace('Re: ' || p_name || '/' || p_type, '[\\/:*?"<>|]+', ' ', 'g'), '\s+', ' ', 'g')), 60) || '.md' AS file, CASE WHEN p_partkey % 2 = 0 THEN 'docx' END AS kind FROM part""")
def mail_files(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", parsing.mail_file_name(F.concat(F.lit("Re: "), "p_name", F.lit("/"), "p_type")).alias("file"), parsing.file_type(F.when(p.p_partkey % 2 == 0, " .DOCX").otherwise("a b")).alias("kind"))


@query(f"""SELECT page_id, 'web-' || {_FNV.replace('text', "regexp_replace(url, '#.*$', '')")} || '-' || {_FNV.replace('text', 'left(html, 50)')} AS doc FROM pages""")
def web_documents(spark, sf):
    """Ids of pages by their address and text."""
    p = table(spark, sf, "pages")
    return p.select("page_id", parsing.web_doc_id(p.url, F.substring("html", 1, 50)).alias("doc"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'Finished.' || CASE WHEN event_id % 2 = 0 THEN ' Saved to Products: a.md, ' || event_type || '.' ELSE '' END || ' Open Automations for details.'
WHEN user_id % 3 = 1 THEN 'Needs your approval for a state-changing step — open Automations to review.' ELSE 'Failed: ' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown error' END END AS said FROM events""")
def run_notifications(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(e.user_id % 3 == 0, "ok").when(e.user_id % 3 == 1, "needs_approval").otherwise("error")
    even = e.event_id % 2 == 0
    return e.select("event_id", parsing.run_notification(status, F.when(even, e.event_type), F.when(even, F.array(F.lit("a.md"), e.event_type))).alias("said"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS next_run, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S.000Z') END AS last_run FROM orders""")
def task_summaries(spark, sf):
    o = table(spark, sf, "orders")
    at = o.o_orderdate.cast("timestamp")
    none = F.lit(None).cast("string")
    t = o.select(
        F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), F.lit("p").alias("prompt"), F.lit(True).alias("enabled"), at.alias("next_run"),
        F.when(o.o_orderkey % 2 == 0, F.timestamp_add("SECOND", F.lit(90), at)).alias("last_run"), none.alias("last_status"), none.alias("last_error"), none.alias("recurrence"),
    )
    return parsing.task_summary(t).select("id", "next_run", "last_run")
