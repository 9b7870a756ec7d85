"""An audit log whose rollup is kept as it grows."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.records import audit_rollup
from .commits import Commits, RevisionConflict

#: Commits of partial sums that are read at most before they are merged.
MERGED = 20


class AuditLog(Commits):
    """events: key, ts and payload columns by these names; a key is a conversation.

    A commit of events writes their partial sums beside them; a deletion writes the keys that go. The rollup is merged from
    the partial sums alone, whatever the number of events, and these are merged into one commit every MERGED commits.
    """

    def __init__(self, spark, home: str, key: str, ts: str, payload: str):
        super().__init__(spark, home)
        self.key, self.ts, self.payload = key, ts, payload

    def append(self, events: DataFrame, expected: int | None = None) -> int:
        now = self.commit({"events": events, "sums": audit_rollup(events, self.key, self.ts, self.payload)}, expected)
        if sum("sums" in e["tables"] for e in self.log()) > MERGED:
            with suppress(RevisionConflict):  # another writer goes on; it merges next time
                now = self.merge()
        return now

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """keys: one column, the key. What is appended to a key later counts again."""
        return self.commit({"gone": keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()}, expected)

    def _live(self, table: str) -> DataFrame | None:
        rows, gone = self.read(table), self.read("gone")
        if rows is None or gone is None:
            return rows
        last = gone.groupBy(self.key).agg(F.max("revision").alias("__gone"))
        return rows.join(last, self.key, "left").where(F.col("__gone").isNull() | (F.col("revision") > F.col("__gone"))).drop("__gone")

    def events(self) -> DataFrame | None:
        """The events that were not deleted; None before the first commit."""
        rows = self._live("events")
        return rows if rows is None else rows.drop("revision")

    def rollup(self) -> DataFrame | None:
        """Per key: events, bytes, first and last time."""
        sums = self._live("sums")
        if sums is None:
            return None
        return sums.groupBy(self.key).agg(
            F.sum("n_events").alias("n_events"), F.sum("n_bytes").alias("n_bytes"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )

    def index(self, order: Column | None = None) -> DataFrame | None:
        """The rollup, the key with the latest event first."""
        rows = self.rollup()
        return rows if rows is None else rows.orderBy(F.desc("last_ts") if order is None else order, self.key)

    def merge(self) -> int:
        """One commit of partial sums in place of all; events stay where they are, and so do the keys that are gone from them."""
        now = self.revision()  # what is committed from here on makes this commit fail
        return self.commit({"sums": self.rollup()}, now, ["sums"])

    def compact(self) -> int:
        """One commit of the events that are left and their sums, in place of all."""
        now = self.revision()
        return self.commit({"events": self.events(), "sums": self.rollup()}, now, ["events", "sums", "gone"])
