"""Conditions and small rules on rows of memories, threads, entities, settings and approvals, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import urls as U
from . import records


def has_text(fields: list[Column], query: str, joined: bool = False) -> Column:
    """Some field holds the trimmed query without regard to case; or all of them ``joined`` by blanks do. No query: every row."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    fields = [F.coalesce(f, F.lit("")) for f in fields]
    if joined:
        return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(q))
    out = F.lit(False)
    for f in fields:
        out = out | F.contains(F.lower(f), F.lit(q))
    return out


def memory_where(status: str | None = None, kind: str | None = None, query: str = "") -> Column:
    """Columns status, kind, label, summary."""
    out = has_text([F.col("label"), F.col("summary")], query)
    for col, value in (("status", status), ("kind", kind)):
        out = out & (F.col(col) == value) if value else out
    return out


def thread_where(project: str | None = None, labels: list[str] | None = None, query: str = "") -> Column:
    """Columns project, labels, title, summary, preview: what the project sees, with one of the labels, and the text."""
    out = records.visible_to(F.col("project"), F.lit(project)) if project is not None else F.col("project").isNull()
    if labels:
        out = out & F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])), F.lit(False))
    return out & has_text([F.col(c) for c in ("title", "summary", "preview")], query, joined=True)


def entity_where(query: str) -> Column:
    """Columns label, type, summary."""
    return has_text([F.col(c) for c in ("label", "type", "summary")], query, joined=True)


def name_where(query: str, *fields: str) -> Column:
    """The first of the fields that is not empty holds the query."""
    return has_text([F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in fields])], query)


def confident(confidence: Column, least: float) -> Column:
    return confidence >= least


def still_valid(expires: Column, now: Column) -> Column:
    """An approval without an end holds for ever."""
    return expires.isNull() | (now < expires)


def host_fits(host: Column, origin: Column) -> Column:
    """Both are normalised first: scheme, path and www do not matter."""
    return U.host_matches(U.normalize_host(host), U.normalize_host(origin))


def trigger_fits(url: Column, pattern: Column) -> Column:
    """The host of a parsed address is the pattern's or below it; what is no address fits nothing."""
    return F.coalesce(host_fits(F.nullif(U.url_host(url), F.lit("")), pattern), F.lit(False))


def allowed_ids(ids: Column, valid: Column, cap: int = 12) -> Column:
    """The ids that are valid, each once, the first ``cap``."""
    return F.slice(F.filter(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))), lambda i: F.array_contains(valid, i)), 1, cap)


def allowed_fields(fields: Column, allowed: list[str]) -> Column:
    """(kept, dropped): the map of the allowed fields, and the names of the others in order of the alphabet."""
    names = F.array(*[F.lit(a) for a in allowed])
    kept = F.map_filter(fields, lambda k, _: F.array_contains(names, k))
    return F.struct(kept.alias("kept"), F.sort_array(F.array_except(F.map_keys(fields), names)).alias("dropped"))


def without_blanks(overrides: Column) -> Column:
    """Entries with a text; null if none is left."""
    kept = F.map_filter(overrides, lambda _, v: F.coalesce(TX.squeeze_ends(v) != "", F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def resolved_prompt(override: Column, default: Column) -> Column:
    """The override as it is, unless it is blank."""
    return F.when(TX.squeeze_ends(override) != "", override).otherwise(default)


def scoped_sources(names: Column) -> Column:
    """(mode, names): trimmed and distinct; without any nothing is restricted."""
    clean = TX.clean_list(F.coalesce(names, F.array().cast("array<string>")))
    return F.struct(F.when(F.size(clean) > 0, "repo_only").otherwise("unrestricted").alias("mode"), clean.alias("names"))


def window_union(selected: Column, targets: Column) -> Column:
    return F.sort_array(F.array_union(selected, targets))


def step_budget(steps: Column, default: int = 20) -> Column:
    """(soft, extension, ceiling): 1 to 1000 steps, half as many more, twice as many at most."""
    soft = F.least(F.lit(1000), F.greatest(F.lit(1), F.floor(F.coalesce(steps.cast("double"), F.lit(default)))))
    half = F.floor(soft / 2 + 0.5)
    return F.struct(soft.alias("soft"), F.greatest(F.lit(1), half).alias("extension"), (soft * 2).alias("ceiling"))


def folder_name(x: Column) -> Column:
    """A folder's name as a collection's: letters, digits, blanks, _ and - stay."""
    clean = TX.squeeze_ends(F.regexp_replace(x, "[^a-zA-Z0-9 _-]", ""))
    return F.concat(F.lit("📁 "), F.coalesce(F.nullif(clean, F.lit("")), F.lit("folder")))


def slug_or(x: Column, fallback: str, limit: int | None = 40) -> Column:
    """A title's slug, cut as it is, or the fallback."""
    s = TX.slug(x, None)
    return F.coalesce(F.nullif(F.substring(s, 1, limit) if limit else s, F.lit("")), F.lit(fallback))


def sorted_by_cell(df: DataFrame, column: str, direction: str | None, *ties: str) -> DataFrame:
    """Rows by a column's cells, up, down or as they are: numbers by value before other cells, which go by their lower case."""
    if direction is None:
        return df
    cell = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    number = F.regexp_extract(cell, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", 1).try_cast("double")
    up = direction == "asc"
    keys = [number.isNull(), number, F.when(number.isNull(), cell)]
    return df.orderBy(*[k.asc_nulls_last() if up else k.desc_nulls_first() for k in keys], *ties)


def recent(df: DataFrame, when: str, n: int, *ties: str) -> DataFrame:
    """The n latest rows."""
    return df.orderBy(F.col(when).desc_nulls_last(), *ties).limit(n)


def save_threads(index: DataFrame, saved: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The index with what was saved, and the ids that go. Both: id, created_at, updated_at, title, labels, project.

    A thread that is there keeps its labels, project and first time; of all the ``keep`` last changed stay.
    """
    old = index.select("id", *[F.col(c).alias(f"__{c}") for c in ("created_at", "labels", "project")], F.lit(True).alias("__there"))
    new = saved.join(old, "id", "left")
    there = F.col("__there").isNotNull()
    new = new.withColumns({
        "created_at": F.coalesce("__created_at", "created_at"), "project": F.coalesce("__project", "project"),
        "labels": F.coalesce(F.when(there, F.col("__labels")), F.col("labels"), F.array().cast("array<string>")),
    }).select(index.columns)
    every = records.retain(records.upsert(index, new, ["id"]), keep, [F.desc("updated_at"), F.col("id")])
    return every.where("kept").drop("kept"), every.where("not kept").select("id")


def disable_orphans(triggers: DataFrame, workflows: DataFrame) -> DataFrame:
    """Triggers (id, enabled, kind, workflow_id) of workflows that are gone are off."""
    live = workflows.select(F.col("id").alias("workflow_id"), F.lit(True).alias("__live"))
    out = triggers.join(live, "workflow_id", "left")
    lost = (F.col("kind") == "workflow") & F.col("__live").isNull()
    return out.withColumn("enabled", F.when(lost, False).otherwise(F.col("enabled"))).select(triggers.columns)


def mark_documents(state: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """doc_id, status, reason: a document is done or failed, never both; what failed again keeps its last reason, what is done has none."""
    new = done.select("doc_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("reason"))
    new = new.unionByName(failed.join(done, "doc_id", "left_anti").select("doc_id", F.lit("failed").alias("status"), "reason"))
    return records.upsert(state, new.dropDuplicates(["doc_id"]), ["doc_id"])
