"""Model replies, service answers and exported files as typed columns; small record rules beside them.

JSON is read by declared schemas: a number or object where text is declared arrives as its JSON text.
Malformed, empty and null input gives null (or the empty list where a list is returned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as TX
from ..functions import urls as U
from . import records

_SLACK = {"mode": "PERMISSIVE"}
MEETING = r"(?i)(https://(?:[^\s<>()\"']+\.)?teams\.(?:microsoft|live)\.com/[^\s<>()\"']+)"
SUBJECT, SENDER, SENT = ["Subject", "Objet"], ["From", "De", "Sender", "Expéditeur"], ["Sent", "Date", "Envoyé"]


def unfenced(x: Column) -> Column:
    """Without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def _json(x: Column, schema: str) -> Column:
    return F.from_json(unfenced(x), schema, _SLACK)


def _text(x: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(TX.squeeze_ends(x), F.lit(""))


def _list(a: Column, limit: int, lower: bool = False) -> Column:
    clean = F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: TX.squeeze_ends(F.lower(s) if lower else s))
    return F.slice(F.filter(clean, lambda s: s.isNotNull() & (s != "")), 1, limit)


def overview(x: Column) -> Column:
    """(title, overview, topics, questions) of a reply, which may stand in prose; null if it says nothing."""
    o = TX.json_object(x, "title string, overview string, keyTopics array<string>, suggestedQuestions array<string>")
    topics, questions, body = _list(o.keyTopics, 12), _list(o.suggestedQuestions, 8), F.coalesce(_text(o.overview), F.lit(""))
    out = F.struct(_text(o.title).alias("title"), body.alias("overview"), topics.alias("topics"), questions.alias("questions"))
    return F.when((body != "") | (F.size(topics) > 0) | (F.size(questions) > 0), out)


def lesson(x: Column, least: float = 0.7) -> Column:
    """(lesson, triggers, tools, origin, confidence); null without a lesson, a trigger or enough confidence."""
    o = _json(x, "lesson string, triggers array<string>, tools array<string>, origin string, confidence double")
    out = F.struct(
        TX.collapse(o.lesson).alias("lesson"), _list(o.triggers, 8, True).alias("triggers"), _list(o.tools, 8).alias("tools"),
        F.lower(_text(o.origin)).alias("origin"), o.confidence.alias("confidence"),
    )
    fits = _text(o.lesson).isNotNull() & (F.size(_list(o.triggers, 8, True)) > 0) & ~F.isnan(o.confidence) & (o.confidence >= least)
    return F.when(fits, out)


def summaries(x: Column, expected: Column) -> Column:
    """A list of exactly so many texts, none of them blank; else null."""
    a = _json(x, "array<string>")
    fits = (expected > 0) & (F.size(a) == expected) & F.forall(a, lambda s: _text(s).isNotNull())
    return F.when(fits, F.transform(a, TX.squeeze_ends))


def verdict(x: Column) -> Column:
    """(revise, issues); whatever cannot be read is no reason to revise."""
    o = _json(x, "verdict string, issues string")
    revise = F.coalesce(F.lower(F.trim(o.verdict)) == "revise", F.lit(False))
    return F.struct(revise.alias("revise"), F.coalesce(_text(o.issues), F.lit("")).alias("issues"))


def thread_meta(x: Column) -> Column:
    o = _json(x, "title string, summary string")
    return F.struct(_text(o.title).alias("title"), _text(o.summary).alias("summary"))


def thread_file(x: Column, apps: list[str], kind: str = "conversation") -> Column:
    """(messages, conversation) as JSON texts of an exported thread of one of these applications; else null."""
    o = F.from_json(x, "app string, kind string, conversation struct<messages: array<string>, conversation: array<string>>", _SLACK)
    body = o.conversation
    return F.when(o.app.isin(apps) & (o.kind == kind) & body.messages.isNotNull() & body.conversation.isNotNull(), body)


def thread_labels(x: Column) -> Column:
    """The complete labels (id, name, color) of an exported thread."""
    kind = "array<struct<id: string, name: string, color: string>>"
    labels = F.coalesce(F.from_json(x, f"labels {kind}", _SLACK).labels, F.array().cast(kind))
    return F.filter(labels, lambda l: l["id"].isNotNull() & l["name"].isNotNull() & l["color"].isNotNull())


def utc_text(when: Column) -> Column:
    """A time without a zone is UTC: it gets its Z. Null: empty."""
    return F.when(F.coalesce(when, F.lit("")) == "", "").when(when.endswith("Z"), when).otherwise(F.concat(when, F.lit("Z")))


def day_range(start: Column, end: Column, today: Column, days: int = 7) -> Column:
    """(start, end) as timestamps: missing ones are today and ``days`` later; a bare date is midnight of the session's zone."""
    first = F.coalesce(F.try_to_timestamp(start), today.cast("date").cast("timestamp"))
    last = F.coalesce(F.try_to_timestamp(end), F.date_add(today.cast("date"), days).cast("timestamp"))
    return F.struct(first.alias("start"), last.alias("end"))


def meeting_url(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(x, MEETING, 1), r"[.,;]+$", ""), F.lit(""))


_BOX = "struct<name: string, address: string>"


def _mailbox(m: Column) -> Column:
    name, address = _text(m["name"]), _text(m.address)
    return F.when(name.isNotNull() & address.isNotNull(), F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(F.coalesce(name, address))


def _body(content: Column, kind: Column) -> Column:
    return F.trim(F.when(F.lower(kind) == "html", TX.strip_html(content)).otherwise(content))


def calendar_events(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """One row for each event of a service's answer that has an id, a start and an end."""
    when = "struct<dateTime: string, timeZone: string>"
    schema = (
        f"value array<struct<id: string, subject: string, start: {when}, end: {when}, location: struct<displayName: string>, "
        f"organizer: struct<emailAddress: {_BOX}>, attendees: array<struct<emailAddress: {_BOX}, type: string>>, bodyPreview: string, "
        "body: struct<contentType: string, content: string>, webLink: string, onlineMeeting: struct<joinUrl: string>>>"
    )
    e = df.select(*keep, F.explode(F.from_json(col, schema, _SLACK).value).alias("e"))
    people = F.coalesce("e.attendees", F.array().cast(f"array<struct<emailAddress: {_BOX}, type: string>>"))
    optional = lambda a: F.coalesce(a.type == "optional", F.lit(False))
    named = lambda a: F.filter(F.transform(a, lambda p: _mailbox(p.emailAddress)), lambda s: s.isNotNull())
    body = _body(F.col("e.body.content"), F.col("e.body.contentType"))
    out = e.select(
        *keep, F.col("e.id").alias("id"), F.coalesce(_text(F.col("e.subject")), F.lit("(no subject)")).alias("subject"),
        utc_text(F.col("e.start.dateTime")).alias("start"), utc_text(F.col("e.end.dateTime")).alias("end"),
        _text(F.col("e.location.displayName")).alias("location"), _mailbox(F.col("e.organizer.emailAddress")).alias("organizer"),
        named(F.filter(people, lambda a: ~optional(a))).alias("required"), named(F.filter(people, optional)).alias("optional"),
        _text(F.col("e.bodyPreview")).alias("preview"), body.alias("body"), F.col("e.webLink").alias("url"),
        F.coalesce("e.onlineMeeting.joinUrl", meeting_url(F.concat_ws("\n", body, "e.location.displayName"))).alias("meeting"),
    )
    return out.where("id <> '' and start <> '' and end <> ''")


def mail_messages(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """One row for each message of a service's answer: its fields, and a text with header lines."""
    schema = (
        f"value array<struct<id: string, subject: string, `from`: struct<emailAddress: {_BOX}>, toRecipients: array<struct<emailAddress: {_BOX}>>, "
        "receivedDateTime: string, bodyPreview: string, body: struct<contentType: string, content: string>, webLink: string>>"
    )
    m = df.select(*keep, F.explode(F.from_json(col, schema, _SLACK).value).alias("m"))
    sender = _mailbox(F.col("m.from.emailAddress"))
    to = F.concat_ws(", ", F.transform("m.toRecipients", lambda r: _mailbox(r.emailAddress)))
    subject = F.trim(F.coalesce(F.nullif("m.subject", F.lit("")), F.lit("(no subject)")))
    body = F.coalesce(_body(F.coalesce("m.body.content", "m.bodyPreview"), F.col("m.body.contentType")), F.col("m.bodyPreview"), F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("From: "), blank(sender), F.lit("\nTo: "), to, F.lit("\nSubject: "), subject, F.lit("\nDate: "), blank(F.col("m.receivedDateTime")))
    return m.select(
        *keep, F.col("m.id").alias("id"), subject.alias("subject"), sender.alias("sender"), F.col("m.receivedDateTime").alias("received"),
        F.try_to_timestamp("m.receivedDateTime").alias("mtime"), F.col("m.webLink").alias("url"), _text(F.col("m.bodyPreview")).alias("preview"),
        TX.squeeze_ends(F.concat(head, F.lit("\n\n"), F.trim(body))).alias("text"),
    )


def playbooks(df: DataFrame, col: str, base: Column, keep: list[str]) -> DataFrame:
    """Entries of an index (a list, or one under ``playbooks``) with a name and an address; the first of a name in each row."""
    entry = "array<struct<name: string, description: string, origin: string, file: string, url: string>>"
    bare = F.trim(F.col(col)).startswith("[")
    listed = F.when(bare, F.from_json(col, entry, _SLACK)).otherwise(F.from_json(col, f"playbooks {entry}", _SLACK).playbooks)
    e = df.withColumn("__row", F.monotonically_increasing_id()).select("__row", *keep, base.alias("__base"), F.posexplode(listed).alias("__at", "e"))
    url = F.when(U.is_http(F.col("e.url")), F.col("e.url")).otherwise(resolve_url(F.col("e.file"), F.col("__base")))
    e = e.withColumns({"name": _text(F.col("e.name")), "url": url}).where("name is not null and url is not null")
    first = W.partitionBy("__row", F.lower("name")).orderBy("__at")
    e = e.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return e.select(*keep, "name", F.coalesce(_text(F.col("e.description")), F.lit("")).alias("description"), _text(F.col("e.origin")).alias("origin"), "url")


def resolve_url(file: Column, base: Column) -> Column:
    """A file's address beside ``base``; null without either."""
    return U.resolved(file, base)


def raw_file_url(x: Column) -> Column:
    """The address of a file's bytes for that of its page in a code host's blob view."""
    return F.regexp_replace(F.trim(x), r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def is_https(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)^\s*https://[^/?#\s]"), F.lit(False))


def host_in(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | U.host_matches(F.lower(host), F.lit(d))
    return out


def page_ref(url: Column, title: Column) -> Column:
    """(url, title, host) of a web page; null for other addresses."""
    return F.when(U.is_http(url) & (U.url_host(url) != ""), F.struct(url.alias("url"), F.trim(title).alias("title"), U.url_host(url).alias("host")))


def file_type(x: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(x)), r"^\.", "")
    return F.when(t.rlike("^[a-z0-9]+$"), t)


def header_line(x: Column, names: list[str]) -> Column:
    """The value of the first line that one of these header names begins."""
    return _text(F.regexp_extract(x, rf"(?im)^[ \t]*(?:{'|'.join(names)})[ \t]*:[ \t]*([^\r\n]+)", 1))


def dragged_mail(html: Column, plain: Column) -> Column:
    """(subject, sender, date, body) of a message dropped as markup and plain text; a sender or a date marks it as mail."""
    plain = F.trim(F.replace(F.coalesce(plain, F.lit("")), F.lit("\r"), F.lit("")))
    body = F.coalesce(_text(TX.strip_html(F.coalesce(html, F.lit("")))), plain)
    source = F.concat_ws("\n", plain, body)
    return F.struct(
        header_line(source, SUBJECT).alias("subject"), header_line(source, SENDER).alias("sender"),
        header_line(source, SENT).alias("date"), body.alias("body"),
    )


def mail_file_name(subject: Column) -> Column:
    clean = F.substring(TX.collapse(F.regexp_replace(F.coalesce(subject, F.lit("email")), r'[\\/:*?"<>|]+', " ")), 1, 60)
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("email")), F.lit(".md"))


def mail_markdown(mail: Column) -> Column:
    told = [F.concat(F.lit(f"**{name}:** "), F.nullif(mail[field], F.lit(""))) for name, field in (("From", "sender"), ("Date", "date"))]
    meta = F.nullif(F.concat_ws("  \n", *told), F.lit(""))
    title = F.concat(F.lit("# "), F.coalesce(mail.subject, F.lit("Email")), F.lit("\n"))
    return F.concat_ws("\n", title, F.concat(meta, F.lit("\n")), F.lit("---\n"), mail.body, F.lit(""))


def memory_from_entries(entries: DataFrame) -> DataFrame:
    """Flat entries (id, text, created_at, updated_at) as memory nodes; the label is the first six words."""
    words = F.split(F.trim("text"), r"\s+")
    label = F.concat(F.array_join(F.slice(words, 1, 6), " "), F.when(F.size(words) > 6, "…").otherwise(""))
    return entries.select(
        "id", F.lit("fact").alias("kind"), label.alias("label"), F.col("text").alias("summary"), F.lit(0.9).alias("confidence"),
        F.lit(0.7).alias("durability"), F.lit("active").alias("status"), "created_at", "updated_at", F.col("updated_at").alias("last_confirmed_at"),
    )


def confirm_memory(nodes: DataFrame, seen: DataFrame, now: Column, keep: int = 10) -> DataFrame:
    """Merge what was seen again (id, summary, confidence, durability, source, seq) into nodes with the same id.

    The longest summary and the highest confidence and durability stay; the last ``keep`` sources are kept.
    """
    s = seen.groupBy("id").agg(
        F.max_by("summary", F.struct(F.length("summary"), -F.col("seq"))).alias("s"), F.max("confidence").alias("c"),
        F.max("durability").alias("d"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x.source).alias("p"),
    )
    j = nodes.join(s, "id", "left")
    again = F.col("c").isNotNull()
    both = F.concat("provenance", F.coalesce("p", F.array().cast("array<string>")))
    changed = {
        "summary": F.when(F.length("s") > F.length("summary"), F.col("s")).otherwise(F.col("summary")),
        "confidence": F.greatest("confidence", "c"), "durability": F.greatest("durability", "d"),
        "status": F.when(again, "active").otherwise(F.col("status")), "updated_at": F.when(again, now).otherwise(F.col("updated_at")),
        "last_confirmed_at": F.when(again, now).otherwise(F.col("last_confirmed_at")),
        "provenance": F.when(again, F.slice(both, F.greatest(F.lit(1), F.size(both) - keep + 1), keep)).otherwise(F.col("provenance")),
    }
    return j.withColumns(changed).select(nodes.columns)


def memory_url(node_id: Column, scheme: str) -> Column:
    return F.concat(F.lit(scheme), node_id)


def memory_id(url: Column, scheme: str) -> Column:
    return F.when(url.startswith(scheme), F.substring(url, F.lit(len(scheme) + 1), F.length(url)))


# fixed values: what a run's record says
RUN_BUSY, RUN_LOST = "Agent was busy; deferred for {} minutes.", "Scheduled task failed."


def settle_run(enabled: Column, busy: Column, ok: Column, needs_approval: Column, error: Column, now: Column, defer: int = 5) -> Column:
    """(status, error, next): a busy runner defers by ``defer`` minutes, and a task that is off has no row's status."""
    status = F.when(~enabled, None).when(busy, "deferred").when(ok, "ok").when(needs_approval, "needs_approval").otherwise("error")
    said = F.when(status == "deferred", F.lit(RUN_BUSY.format(defer))).when(
        status.isin("error", "needs_approval"), F.coalesce(error, F.lit(RUN_LOST))
    )
    later = F.when(status == "deferred", now.cast("timestamp") + F.expr(f"interval {defer} minutes"))
    return F.struct(status.alias("status"), said.alias("error"), later.alias("next"))


# fixed values: what a run's notification says
RUN_OK, RUN_APPROVAL, RUN_FAILED = "Open Automations for details.", "Needs your approval for a state-changing step — open Automations to review.", "unknown error"


def run_notification(status: Column, error: Column, files: Column) -> Column:
    """What a finished run tells its owner. files: names of what it has saved, null or empty for nothing."""
    saved = F.when(F.size(F.coalesce(files, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" Saved to Products: "), F.array_join(files, ", "), F.lit("."))).otherwise("")
    return (
        F.when(status == "ok", F.concat(F.lit("Finished."), saved, F.lit(f" {RUN_OK}"))).when(status == "needs_approval", RUN_APPROVAL)
        .otherwise(F.concat(F.lit("Failed: "), F.coalesce(error, F.lit(RUN_FAILED))))
    )


def task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks as they are listed: times as ISO texts, those that never were as null. tasks: id, title, prompt, enabled, next_run, last_run, last_status, last_error, recurrence."""
    iso = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    return tasks.select("id", "title", "prompt", "enabled", iso("next_run"), iso("last_run"), "last_status", "last_error", "recurrence")


def older_than(when: Column, now: Column, seconds: int) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(when.cast("timestamp")) > F.lit(seconds * 1_000_000)


def counts_moved(had: list[Column], has: list[Column]) -> Column:
    """Something was never made, or was made when counts (or a revision) were others."""
    out = F.lit(False)
    for a, b in zip(had, has):
        out = out | ~a.eqNullSafe(b) | a.isNull()
    return out


def source_allowed(name: Column, external: list[str], restricted: Column, approved: Column) -> Column:
    """An external source may be used if nothing is restricted or the web is approved."""
    return ~restricted | approved | ~name.isin(external)


def repository_allowed(repo: Column, allowed: Column, restricted: Column) -> Column:
    return ~restricted | F.array_contains(allowed, repo)


def host_events(events: DataFrame, target: Column, order: list[str], partition: list[str], keep: int = 200) -> DataFrame:
    """The last ``keep`` events of each recording on its target host. Needs host."""
    fits = events.where(U.host_matches(F.col("host"), target))
    last = W.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order])
    return fits.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= keep).drop("__n")


# fixed values: parts of a playbook that was recorded
NO_STEPS = "1. No interactions were captured."
RECORDED_NOTES = "## Notes\n- This playbook was generated from recorded user interactions.\n- Edit it in Settings → Skills to refine wording or add missing context."


def learned_playbook(events: DataFrame, recordings: DataFrame) -> DataFrame:
    """recording, name, description, body: the lines of each recording's events in order, without immediate repeats.

    events: recording, seq, line (``action_line``), signature (what makes two events the same), page_url, page_title,
    page_host; recordings: recording, host, title. A line names its page where that is another than the line's before.
    """
    w = W.partitionBy("recording").orderBy("seq")
    e = records.drop_repeats(events, ["recording"], ["seq"], F.col("signature"))
    label = F.coalesce(F.nullif("page_title", F.lit("")), F.nullif("page_host", F.lit("")))
    moved = ~F.coalesce(F.lag("page_url").over(w), F.lit("")).eqNullSafe(F.col("page_url")) & label.isNotNull()
    e = e.withColumn("text", F.concat("line", F.when(moved, F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(""))).withColumn("n", F.row_number().over(w))
    e = e.withColumn("text", F.concat(F.col("n").cast("string"), F.lit(". "), "text"))
    steps = e.groupBy("recording").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x.text), "\n").alias("steps"))
    out = recordings.join(steps, "recording", "left")
    of = F.concat(F.lit("Recorded workflow for "), "host")
    slug = F.regexp_replace(F.regexp_replace("host", "(?i)[^a-z0-9]+", "-"), "^-+|-+$", "")
    title = F.coalesce(F.nullif("title", F.lit("")), "host")
    body = F.concat(F.lit("# "), of, F.lit("\n\nRecorded from "), title, F.lit(".\n\n## Flow\n"), F.coalesce("steps", F.lit(NO_STEPS)), F.lit("\n\n" + RECORDED_NOTES))
    return out.select("recording", F.concat(F.lit("learn-"), F.lower(slug)).alias("name"), of.alias("description"), body.alias("body"))


def capabilities_of_sites(sites: DataFrame, now: Column) -> DataFrame:
    """Entries of a capability registry for known sites (id, name, description, url, mcp_url, mcp_token, search_url)."""
    remote, token = F.coalesce(F.col("mcp_url") != "", F.lit(False)), F.coalesce(F.col("mcp_token") != "", F.lit(False))
    return sites.select(
        F.concat(F.lit("cap-"), F.sha2(F.col("id").cast("string"), 256).substr(1, 12)).alias("id"), F.when(remote, "mcp").otherwise("bookmark").alias("kind"), "name", "description",
        F.nullif("url", F.lit("")).alias("url"), F.when(token, "token").otherwise("browser-session").alias("auth_method"), F.when(token, F.col("mcp_token")).alias("auth_token"),
        F.lit("local").alias("trust"), F.when(remote, F.array(F.lit("mcp"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit("manual").alias("source"),
        now.alias("discovered_at"), now.alias("last_seen_at"), "mcp_url", "search_url",
    )


def action_line(kind: Column, target: Column, key: Column, value: Column) -> Column:
    value = _text(value)
    return (
        F.when(kind == "click", F.concat(F.lit("Click "), target)).when(kind == "submit", F.concat(F.lit("Submit "), target))
        .when(kind == "keydown", F.concat(F.lit("Press "), F.coalesce(key, F.lit("a key")), F.lit(" in "), target))
        .when((kind == "input") & value.isNotNull(), F.concat(F.lit("Type "), value, F.lit(" into "), target))
        .when(kind == "input", F.concat(F.lit("Type into "), target))
    )


def web_doc_id(url: Column, text: Column) -> Column:
    """A citable id of a page's text: hashes of its address and of the text."""
    return F.concat(F.lit("web-"), TX.short_hash(U.canonical_url(url)), F.lit("-"), TX.short_hash(text))
