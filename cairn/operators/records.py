"""Operators on tables of records: filters, diffs, upserts, retention, rollups, policy, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import ensure_checkpoint_dir


def any_cell_contains(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns])
    return df.where(F.exists(cells, lambda c: F.contains(F.lower(c), F.lit(text.lower()))))


def all_terms(columns: list[Column], query: Column) -> Column:
    """Every blank-separated term of the query is in the fields together."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), lambda t: hay.contains(t))


def visible_to(project: Column, active: Column) -> Column:
    return project.isNull() | (project == active)


def page(df: DataFrame, n_rows: int, number: int, size: int, *order) -> DataFrame:
    """A page counted from 0; a number past the end gives the last page."""
    last = max(0, -(-n_rows // size) - 1)
    return df.orderBy(*order).offset(min(max(0, number), last) * size).limit(size)


def _sorted_ranges(df: DataFrame, order: list) -> DataFrame:
    """Rows sorted by ranges of ``order`` and written once, with the number of their range and their place in it."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    return rows.withColumns({"__range": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")


def _before(sums: DataFrame, total: str) -> DataFrame:
    """__range, __before: the total of the ranges before each; ``sums`` has a row for each partition."""
    w = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(sums.select("__range", F.coalesce(F.sum(total).over(w), F.lit(0)).alias("__before")))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add each row's place, from 1, in the order of the whole table, without one task that holds all rows."""
    rows = _sorted_ranges(df, order)
    before = _before(rows.groupBy("__range").agg(F.count("*").alias("__n")), "__n")
    return rows.join(before, "__range").withColumn(name, F.col("__in") + F.col("__before") + 1).drop("__range", "__in", "__before")


def running_total(df: DataFrame, order: list, value: Column, name: str = "total") -> DataFrame:
    """Add the sum of ``value`` up to each row in the order of the whole table, range by range."""
    rows = _sorted_ranges(df.withColumn("__v", value), order)
    before = _before(rows.groupBy("__range").agg(F.sum("__v").alias("__n")), "__n")
    inner = W.partitionBy("__range").orderBy("__in").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(before, "__range").withColumn(name, F.col("__before") + F.sum("__v").over(inner)).drop("__range", "__in", "__before", "__v")


def retain(df: DataFrame, n: int, newest: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Add ``kept``: whether a row is among the n newest (of its partition)."""
    if partition:
        return df.withColumn("kept", F.row_number().over(W.partitionBy(*partition).orderBy(*newest)) <= n)
    return ranked(df, newest, "__rank").withColumn("kept", F.col("__rank") <= n).drop("__rank")


def first_occurrence(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def drop_repeats(df: DataFrame, partition: list[str], order: list[str], signature: Column) -> DataFrame:
    """Rows whose signature differs from the row before."""
    w = W.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("__s", signature)
    out = out.withColumn("__p", F.lag("__s").over(w)).withColumn("__n", F.row_number().over(w))
    return out.where((F.col("__n") == 1) | ~F.col("__s").eqNullSafe(F.col("__p"))).drop("__s", "__p", "__n")


def sync_diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, state: new, removed, changed or unchanged."""
    a = old.select(key, F.struct(*compare).alias("a"))
    b = new.select(key, F.struct(*compare).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed")
    state = state.when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those with the same key; others are appended."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def duplicate_urls(left: DataFrame, right: DataFrame, left_url: str, right_url: str) -> DataFrame:
    """Pairs of rows whose normalised URLs are equal."""
    a = left.withColumn("norm_url", U.normalize_url(F.col(left_url)))
    b = right.withColumn("norm_url", U.normalize_url(F.col(right_url)))
    return a.join(b, "norm_url")


def missing_by_key(expected: DataFrame, there: DataFrame, key: Column, there_key: Column) -> DataFrame:
    e, t = expected.withColumn("__k", key), there.select(there_key.alias("__k"))
    return e.join(t, "__k", "left_anti").drop("__k")


def audit_rollup(events: DataFrame, key: str, ts: str, payload: str) -> DataFrame:
    """Per key: events, bytes, first and last time."""
    return events.groupBy(key).agg(
        F.count("*").alias("n_events"), F.sum(F.octet_length(payload)).cast("long").alias("n_bytes"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def latency_summary(df: DataFrame, key: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95), percent: bool = False) -> DataFrame:
    """n, min, the percentiles ``at`` (p50, p95), max and mean; a percentile is the element at floor(p * n) of the sorted values.

    percent: ``at`` is out of 100. Equal values are counted before they are sorted, and the sort of a key's
    values is dealt out by ranges of the whole table, so a key that holds most rows is no single task.
    """
    at = tuple(p / 100 for p in at) if percent else at
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__c"))
    ensure_checkpoint_dir(df.sparkSession)
    rows = counts.orderBy(*key, value).withColumn("__range", F.spark_partition_id()).checkpoint()
    sums = rows.groupBy(*key, "__range").agg(F.sum("__c").alias("__s"))  # a row for each key and partition
    before = sums.withColumns({
        "__before": F.coalesce(F.sum("__s").over(W.partitionBy(*key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "__n": F.sum("__s").over(W.partitionBy(*key)),
    }).drop("__s")
    rows = rows.join(before, [*key, "__range"])
    inner = W.partitionBy(*key, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__hi", F.col("__before") + F.sum("__c").over(inner))  # places before __hi hold this value or a smaller one
    place = lambda p: F.least(F.floor(F.lit(p) * F.col("__n")), F.col("__n") - 1)
    nth = lambda p: F.min(F.when(F.col("__hi") > place(p), F.col(value)))
    return rows.groupBy(*key).agg(
        F.first("__n").alias("n"), F.min(value).alias("min"), *[nth(p).alias(f"p{round(100 * p)}") for p in at], F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("__c")) / F.first("__n")).alias("mean"),
    )


def in_cooldown(last: Column, now: Column, minutes: int = 60) -> Column:
    return last.isNotNull() & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) < minutes * 60_000_000)


# fixed values: kinds of action from least to most control, levels of trust from least to most
ACTIONS = ["read", "low_risk_write", "external_comms", "record_modification", "destructive", "financial_legal"]
TRUST = ["public", "community", "verified", "enterprise", "local"]


def _rank(x: Column, names: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in names]), x), F.lit(0)) - 1


def trust_rank(level: Column) -> Column:
    """Place in TRUST; unknown and missing levels have the lowest."""
    return F.greatest(_rank(level, TRUST), F.lit(0))


def trusted(level: Column) -> Column:
    return trust_rank(level) >= TRUST.index("enterprise")


def policy(action: Column, trust: Column, attended: Column, capability: Column, approved: Column, blocked: Column) -> Column:
    """The first rule that matches decides: deny, needs_approval or allow.

    capability: the tool comes from one; approved: for this session; blocked: never unattended. Financial acts
    are denied, unattended runs only read, approval does not reach past record changes, reads of capabilities
    that are not trusted need approval, drafts are allowed, all else needs approval.
    """
    low = capability & ~trusted(trust)
    alone = F.when(blocked | (action != "read") | low, "deny").otherwise("allow")
    return (
        F.when(action == "financial_legal", "deny").when(~attended, alone)
        .when(approved & (_rank(action, ACTIONS) <= ACTIONS.index("record_modification")), "allow")
        .when(action == "read", F.when(low, "needs_approval").otherwise("allow"))
        .when(action == "low_risk_write", "allow").otherwise("needs_approval")
    )


def classify(df: DataFrame, classes: DataFrame, key: str, default: str) -> DataFrame:
    """Look up ``action`` of a key; unknown keys get the default."""
    return df.join(classes, key, "left").withColumn("action", F.coalesce("action", F.lit(default)))


def config_diff(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fields (key, value) of incoming that differ."""
    j = incoming.alias("i").join(current.alias("c"), "key", "left")
    return j.where(~F.col("i.value").eqNullSafe(F.col("c.value"))).select("key", F.col("c.value").alias("old"), F.col("i.value").alias("new"))


def export_table(df: DataFrame, limit: int = 5000) -> DataFrame:
    """All cells as strings; the export's own limit of rows."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).limit(limit)


def term_rank(df: DataFrame, terms: list[str], text: Column, ties: list[str], n: int) -> DataFrame:
    """Rows by how many terms they hold, the n best."""
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t)))
    return df.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), *ties).limit(n)


def frontier_add(seen: DataFrame, found: DataFrame, key: str, order: list[str], depth: int, cap: int) -> DataFrame:
    """Found items not seen, within depth, once each, at most cap in all."""
    room = max(0, cap - seen.count())
    fresh = first_occurrence(found.where(F.col("depth") <= depth).join(seen.select(key), key, "left_anti"), [key], order)
    return fresh.orderBy(*order).limit(room)


def crawl(seeds: DataFrame, links: DataFrame, depth: int, cap: int) -> DataFrame:
    """key, depth: breadth first from the seeds over links (key, target), each round one join; bounded by depth and cap."""
    ensure_checkpoint_dir(seeds.sparkSession)
    seen = seeds.select("key", F.lit(0).alias("depth")).distinct().orderBy("key").limit(cap)
    edge = seen
    for d in range(1, depth + 1):
        found = edge.join(links, "key").select(F.col("target").alias("key"), F.lit(d).alias("depth")).distinct()
        edge = frontier_add(seen, found, "key", ["key"], depth, cap).checkpoint()
        seen = seen.unionByName(edge)
    return seen


def repair_pairs(messages: DataFrame) -> DataFrame:
    """A placeholder row after each tool call without a reply. messages: conv_id, seq, role, call_id, text."""
    calls = messages.where("role = 'assistant' and call_id is not null")
    replies = messages.where("role = 'tool'").select("conv_id", "call_id")
    lost = calls.join(replies, ["conv_id", "call_id"], "left_anti")
    lost = lost.select("conv_id", (F.col("seq") + 0.5).alias("seq"), F.lit("tool").alias("role"), "call_id", F.lit("[no result]").alias("text"))
    return messages.withColumn("seq", F.col("seq").cast("double")).select(lost.columns).unionByName(lost)


def next_run(kind: Column, now: Column, minutes: Column, at: Column, weekdays: Column) -> Column:
    """Next time of an interval, daily or weekly task, else null.

    at: strict HH:MM in the session's zone; weekdays: an array, Sunday is 0, others than 0 to 6 are ignored.
    An interval is of whole minutes, one at least.
    """
    ok = at.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    day = F.to_date(now)
    on = lambda d: F.try_to_timestamp(F.concat(d.cast("string"), F.lit(" "), at), F.lit("yyyy-MM-dd HH:mm"))
    daily = F.when(on(day) > now, on(day)).otherwise(on(F.date_add(day, 1)))
    week = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.date_add(day, k))
    week = F.filter(week, lambda d: F.array_contains(weekdays.cast("array<int>"), F.dayofweek(d) - 1))
    weekly = F.try_element_at(F.filter(F.transform(week, on), lambda t: t > now), F.lit(1))
    whole = F.floor(minutes.cast("double"))
    every = F.when(whole >= 1, F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + whole * 60_000_000))
    return F.when(kind == "interval", every).when((kind == "daily") & ok, daily).when((kind == "weekly") & ok, weekly)


# fixed values: patterns of login pages and hosts of identity providers
LOGIN_URL = r"(?i)(login|log-in|signin|sign-in|sign_in|logon|sso|oauth|saml|account/login)"
LOGIN_TEXT = (
    r"(?i)(sign in to continue|log in to continue|please sign in|please log in|session (has )?expired|authentication required|you must (sign|log) in)"
)
LOGIN_TITLE = r"(?i)(sign in|log in|login|authenticate)"
PROVIDERS = (
    (r"(?i)accounts\.google\.com", "Google"),
    (r"(?i)login\.microsoftonline\.com|login\.live\.com", "Microsoft"),
    (r"(?i)\.okta\.com", "Okta"),
    (r"(?i)\.auth0\.com", "Auth0"),
    (r"(?i)\.onelogin\.com", "OneLogin"),
    (r"(?i)\.pingidentity\.com|\.pingone\.", "Ping Identity"),
    (r"(?i)id\.atlassian\.com", "Atlassian"),
)


def provider(url: Column) -> Column:
    """The identity provider whose host a URL has, else null."""
    out = F.when(url.rlike(PROVIDERS[0][0]), PROVIDERS[0][1])
    for pattern, name in PROVIDERS[1:]:
        out = out.when(url.rlike(pattern), name)
    return out


def auth_state(status: Column, url: Column, title: Column, text: Column, password: Column, form: Column) -> Column:
    """blocked, auth_required, unknown or authenticated of an extracted page.

    A password field, a login form or a provider's host is enough; a text that asks to sign in needs a URL or
    title that says so too. A page of less than 50 characters is unknown.
    """
    asks = F.substring(text, 1, 5000).rlike(LOGIN_TEXT) & (url.rlike(LOGIN_URL) | title.rlike(LOGIN_TITLE))
    return (
        F.when(status.isin("blocked", "unsupported"), "blocked").when(password | form | provider(url).isNotNull() | asks, "auth_required")
        .when(F.length(text) < 50, "unknown").otherwise("authenticated")
    )


def job_transition(status: Column, command: Column) -> Column:
    """New status; a command that the status does not allow changes nothing."""
    return (
        F.when((command == "start") & status.isin("queued", "paused"), "running").when((command == "pause") & (status == "running"), "paused")
        .when((command == "resume") & (status == "paused"), "running").when((command == "cancel") & status.isin("queued", "running", "paused"), "cancelled")
        .otherwise(status)
    )
