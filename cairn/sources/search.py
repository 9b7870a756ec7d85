"""Searches over mail, files and calendars as predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.records import all_terms


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def mail_filter(sender: str | None = None, subject: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Columns sender, subject, received: contains without regard to case; since is included, until is not."""
    parts = []
    if sender:
        parts.append(F.lower("sender").contains(sender.lower()))
    if subject:
        parts.append(F.lower("subject").contains(subject.lower()))
    if since:
        parts.append(F.col("received") >= F.lit(since).cast("timestamp"))
    if until:
        parts.append(F.col("received") < F.lit(until).cast("timestamp"))
    return _all(parts)


def file_filter(terms: str = "", kinds: list[str] | None = None, folder: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Columns name, path, mtime: all terms, one of the extensions, below a folder, changed between."""
    parts = [F.lower(F.concat_ws(" ", "name", "path")).contains(t) for t in terms.lower().split()]
    if kinds:
        parts.append(F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).isin([k.lower().lstrip(".") for k in kinds]))
    if folder:
        parts.append(F.col("path").startswith(folder))
    if since:
        parts.append(F.col("mtime") >= F.lit(since).cast("timestamp"))
    if until:
        parts.append(F.col("mtime") < F.lit(until).cast("timestamp"))
    return _all(parts)


def calendar_search(events: DataFrame, start: str, end: str, query: str = "", limit: int = 25) -> DataFrame:
    """Events that overlap the range and hold all terms, by start. events: id, subject, place, people, start, end."""
    inside = (F.col("start") < F.lit(end).cast("timestamp")) & (F.col("end") > F.lit(start).cast("timestamp"))
    text = [F.col(c) for c in ("subject", "place", "people")]
    return events.where(inside & all_terms(text, F.lit(query))).orderBy("start", "id").limit(min(100, max(1, limit)))


def fan_out(mail: DataFrame, files: DataFrame, mail_where: Column, file_where: Column, limit: int = 10) -> DataFrame:
    """kind, pos, id, title: the newest of both searches side by side, each with its own places."""
    n = min(25, max(1, limit))
    a = mail.where(mail_where).orderBy(F.desc("received"), "id").limit(n).select(F.lit("mail").alias("kind"), "id", F.col("subject").alias("title"), F.col("received").alias("at"))
    b = files.where(file_where).orderBy(F.desc("mtime"), "id").limit(n).select(F.lit("file").alias("kind"), "id", F.col("name").alias("title"), F.col("mtime").alias("at"))
    from pyspark.sql import Window as W

    every = a.unionByName(b)
    return every.select("kind", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("at"), "id")).alias("pos"), "id", "title")


def library(files: DataFrame, extensions: list[str], cap: int = 1000) -> DataFrame:
    """Files with one of the extensions, the first ``cap`` by path (the listing's own limit)."""
    return files.where(file_filter(kinds=extensions)).orderBy("path", "name").limit(cap)


def high_water(df: DataFrame, ts: str):
    """The newest time seen, or None."""
    return df.agg(F.max(ts)).first()[0]


def without_markup(summary: Column) -> Column:
    """A search summary without highlight marks and ellipsis tags."""
    t = F.regexp_replace(summary, r"</?c\d+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<ddd\s*/?>", "…"), r"\s+", " "))


def claim_name(claim: Column) -> Column:
    """The last part of a claims string."""
    return F.trim(F.element_at(F.split(claim, r"\|"), -1))
