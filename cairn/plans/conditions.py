"""Queries for conditions and small rules on rows, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..session import table
from .queries import _now, query


@query("""SELECT event_id FROM events WHERE (CASE WHEN event_id % 3 = 0 THEN 'stale' ELSE 'active' END) = 'active' AND event_type = 'click' AND (contains('user ' || user_id, '1') OR contains(lower(props), '1'))""")
def filtered_memories(spark, sf):
    e = table(spark, sf, "events")
    m = e.select("event_id", F.when(e.event_id % 3 == 0, "stale").otherwise("active").alias("status"), F.col("event_type").alias("kind"), F.concat(F.lit("User "), e.user_id).alias("label"), F.col("props").alias("summary"))
    return m.where(filters.memory_where("active", "click", " 1 ")).select("event_id")


@query("""SELECT conv_id, turn FROM conversations WHERE (turn % 3 = 0 OR turn % 3 = 1) AND (role IN ('user') OR turn = 2) AND contains(lower('T' || turn || ' ' || '' || ' ' || text), 'th')""")
def filtered_threads(spark, sf):
    """What a project sees, by one of two labels and a text."""
    c = table(spark, sf, "conversations")
    project = F.when(c.turn % 3 == 1, "p1").when(c.turn % 3 == 2, "p2")
    t = c.select("conv_id", "turn", project.alias("project"), F.array(c.role, F.concat(F.lit("t"), c.turn)).alias("labels"), F.concat(F.lit("T"), c.turn).alias("title"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("preview"))
    return t.where(filters.thread_where("p1", ["user", "t2"], "TH")).select("conv_id", "turn")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'r economy') AND contains(lower(CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END), 'b') AND p_retailprice >= 901")
def filtered_entities(spark, sf):
    """Entities by a text across their fields, names by the first field that has one, and confidence."""
    p = table(spark, sf, "part")
    e = p.select("p_partkey", F.col("p_name").alias("label"), F.col("p_type").alias("type"), F.col("p_brand").alias("summary"), F.when(p.p_size % 2 == 0, p.p_name).otherwise("").alias("name"), F.col("p_brand").alias("url"), "p_retailprice")
    return e.where(filters.entity_where("R Economy") & filters.name_where("B", "name", "url") & filters.confident(F.col("p_retailprice"), 901)).select("p_partkey")


@query("""SELECT event_id, event_id % 3 = 0 OR ts + INTERVAL 50 DAY > TIMESTAMP '2024-03-01' AS valid, (user_id % 4 + 1 <= 3) AS fits FROM events""")
def valid_approvals(spark, sf):
    """Approvals that hold, and triggers that fit an address."""
    e = table(spark, sf, "events")
    expires = F.when(e.event_id % 3 != 0, F.timestamp_add("DAY", F.lit(50), e.ts))
    urls = F.element_at(F.array(F.lit("https://www.example.org/x?q"), F.lit("http://u@a.b.Example.org:80/"), F.lit("http://example.org"), F.lit("http://badexample.org/")), (e.user_id % 4 + 1).cast("int"))
    return e.select("event_id", filters.still_valid(expires, _now()).alias("valid"), filters.trigger_fits(urls, F.lit("https://www.Example.org/any")).alias("fits"))


@query("""SELECT page_id, page_id % 3 < 2 AS fits FROM pages""")
def fitting_hosts(spark, sf):
    p = table(spark, sf, "pages")
    host = F.when(p.page_id % 3 == 0, "WWW.Example.org").when(p.page_id % 3 == 1, "docs.example.org").otherwise("")
    return p.select("page_id", filters.host_fits(host, F.lit("https://example.org/path")).alias("fits"))


@query("""SELECT event_id, 's' || user_id % 5 || CASE WHEN user_id % 5 <> event_id % 5 THEN ' s' || event_id % 5 ELSE '' END AS ids, event_type AS kept, 'b,c' AS dropped, event_id % 2 = 0 AS overridden, CASE WHEN event_id % 2 = 0 THEN ' x ' ELSE 'default' END AS prompt FROM events""")
def allowed_values(spark, sf):
    """Ids and settings that are allowed, prompts that are overridden."""
    e = table(spark, sf, "events")
    ids = F.array(F.concat(F.lit("s"), e.user_id % 5), F.lit("zz"), F.concat(F.lit("s"), e.event_id % 5), F.concat(F.lit("s"), e.user_id % 5))
    valid = F.array(*[F.lit(f"s{i}") for i in range(5)])
    fields = filters.allowed_fields(F.create_map(F.lit("c"), F.lit("1"), F.lit("a"), e.event_type, F.lit("b"), F.lit("2")), ["a", "z"])
    said = F.when(e.event_id % 2 == 0, " x ").otherwise(" \n ")
    blank = filters.without_blanks(F.create_map(F.lit("k"), said, F.lit("l"), F.lit(None).cast("string")))
    return e.select(
        "event_id", F.array_join(filters.allowed_ids(ids, valid), " ").alias("ids"), fields.kept["a"].alias("kept"), F.array_join(fields.dropped, ",").alias("dropped"),
        blank.isNotNull().alias("overridden"), filters.resolved_prompt(said, F.lit("default")).alias("prompt"),
    )


@query("""SELECT o_orderkey, least(1000, greatest(1, o_orderkey % 1500 - 2))::BIGINT AS soft, greatest(1, floor(least(1000, greatest(1, o_orderkey % 1500 - 2)) / 2 + 0.5))::BIGINT AS extension, least(1000, greatest(1, o_orderkey % 1500 - 2))::BIGINT * 2 AS ceiling,
CASE WHEN o_orderkey % 2 = 0 THEN 'repo_only:a,b' ELSE 'unrestricted:' END AS scope, '0,1,' || CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE o_orderkey % 5 || ',' END || '9' AS windows FROM orders""")
def step_budgets(spark, sf):
    """Budgets of steps, scopes of sources, united windows."""
    o = table(spark, sf, "orders")
    b = filters.step_budget(o.o_orderkey % 1500 - 1.5)
    s = filters.scoped_sources(F.when(o.o_orderkey % 2 == 0, F.array(F.lit(" a"), F.lit(""), F.lit("b"), F.lit("a "))))
    w = filters.window_union(F.array(F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(9).cast("long")), F.array((o.o_orderkey % 5).cast("long"), F.lit(1).cast("long")))
    return o.select(
        "o_orderkey", b.soft.cast("long").alias("soft"), b.extension.cast("long").alias("extension"), b.ceiling.cast("long").alias("ceiling"),
        F.concat(s["mode"], F.lit(":"), F.array_join(s.names, ",")).alias("scope"), F.array_join(F.transform(w, lambda x: x.cast("string")), ",").alias("windows"),
    )


@query(r"""SELECT p_partkey, left(regexp_replace(regexp_replace(lower('Ünder ' || p_name || ' -- ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS thread, regexp_replace(regexp_replace(lower(p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS skill, 'research' AS job,
'📁 ' || trim(regexp_replace(p_brand || '/' || p_name || ' ', '[^a-zA-Z0-9 _-]', '', 'g')) AS folder FROM part""")
def slugs(spark, sf):
    """Slugs of threads, skills, jobs and folders."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", filters.slug_or(F.concat(F.lit("Ünder "), "p_name", F.lit(" -- "), "p_type"), "conversation").alias("thread"), filters.slug_or(F.concat("p_name", F.lit("!")), "imported-skill", None).alias("skill"),
        filters.slug_or(F.lit("¿?"), "research").alias("job"), filters.folder_name(F.concat("p_brand", F.lit("/"), "p_name", F.lit(" "))).alias("folder"),
    )


@query("""SELECT p_partkey FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 > 0 ORDER BY p_size, p_partkey LIMIT 25)""")
def sorted_cells(spark, sf):
    """Numbers in texts go by value, before other cells."""
    p = table(spark, sf, "part")
    cell = F.when(p.p_partkey % 4 == 0, "none").otherwise(F.concat(F.lit(" "), p.p_size, F.lit(" pcs")))
    return filters.sorted_by_cell(p.withColumn("cell", cell), "cell", "asc", "p_partkey").limit(25).select("p_partkey")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 15")
def recent_runs(spark, sf):
    return filters.recent(table(spark, sf, "events"), "ts", 15, "event_id").select("event_id")


@query("""WITH i AS (SELECT conv_id AS id, 1 AS created, 100 + conv_id AS updated, 'l' || conv_id AS labels, CASE WHEN conv_id % 2 = 0 THEN 'p' END AS project FROM conversations GROUP BY conv_id), s AS (SELECT id * 2 AS id, 7 AS created, 1000 + id AS updated, 'new' AS labels, 'q' AS project FROM i),
n AS (SELECT s.id, coalesce(i.created, s.created) AS created, s.updated, coalesce(i.labels, s.labels) AS labels, coalesce(i.project, s.project) AS project FROM s LEFT JOIN i USING (id)), u AS (FROM n UNION ALL SELECT * FROM i WHERE id NOT IN (SELECT id FROM n))
SELECT id, created, labels, project, row_number() OVER (ORDER BY updated DESC, id) <= 60 AS kept FROM u""")
def saved_threads(spark, sf):
    """Threads saved again keep their labels, project and first time; of all the sixty last changed stay."""
    i = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    index = i.select("id", F.lit(1).alias("created_at"), (F.col("id") + 100).alias("updated_at"), F.lit("t").alias("title"), F.array(F.concat(F.lit("l"), "id")).alias("labels"), F.when(i.id % 2 == 0, "p").alias("project"))
    saved = i.select((F.col("id") * 2).alias("id"), F.lit(7).alias("created_at"), (F.col("id") + 1000).alias("updated_at"), F.lit("t").alias("title"), F.array(F.lit("new")).alias("labels"), F.lit("q").alias("project"))
    kept, _ = filters.save_threads(index, saved, 60)
    every, _ = filters.save_threads(index, saved, 1_000_000)
    flag = kept.select("id", F.lit(True).alias("kept"))
    return every.join(flag, "id", "left").select("id", F.col("created_at").alias("created"), F.array_join("labels", "").alias("labels"), "project", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""SELECT event_id AS id, user_id % 2 = 0 AND NOT (event_type = 'click' AND user_id % 7 = 0) AS enabled FROM events""")
def orphaned_triggers(spark, sf):
    """Triggers of workflows that are gone are off; others stay as they are."""
    e = table(spark, sf, "events")
    t = e.select(F.col("event_id").alias("id"), (e.user_id % 2 == 0).alias("enabled"), F.when(e.event_type == "click", "workflow").otherwise("prompt").alias("kind"), F.col("user_id").alias("workflow_id"))
    w = e.select(F.col("user_id").alias("id")).distinct().where("id % 7 <> 0")
    return filters.disable_orphans(t, w).select("id", "enabled")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'done' WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 = 0 THEN 'again' ELSE '' END AS reason FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 2 = 0""")
def document_states(spark, sf):
    """Every second document was done; every third is, every fourth has failed."""
    d = table(spark, sf, "documents").select("doc_id")
    state = d.where("doc_id % 2 = 0").select("doc_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("reason"))
    out = filters.mark_documents(state, d.where("doc_id % 3 = 0"), d.where("doc_id % 4 = 0").withColumn("reason", F.lit("again")))
    return out.select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"))
