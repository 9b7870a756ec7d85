"""A store of conversations: saved, relabelled, deleted, exported and imported in atomic commits over several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commits import Commits

#: columns of an entry of the index beside its id and labels
ENTRY = {"title": "string", "summary": "string", "preview": "string", "updated_at": "timestamp", "message_count": "long"}
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
MESSAGE = {"seq": "long", "role": "string", "text": "string"}


def _shaped(rows: DataFrame, keys: dict, columns: dict) -> DataFrame:
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (keys | columns).items()])


class Threads(Commits):
    """Entries (id, title, summary, preview, updated_at, message_count, labels), their messages (id, seq, role, text) and the
    registry of labels (label, color).

    A conversation's messages are those of the last commit that saved it. Labels are kept apart from entries, so saving a
    conversation again leaves them alone. A deletion is a row that hides what was saved before it.
    """

    def save(self, entries: DataFrame, messages: DataFrame, expected: int | None = None, labels: DataFrame | None = None, registry: DataFrame | None = None) -> int:
        """Save conversations with their messages, and in the same commit labels (id, labels) and a new registry, if given.

        Messages of ids without an entry, and entries without a message, are left out. Of rows with one id, or one id and
        seq, one is saved: the latest entry, the largest message.
        """
        entries = _shaped(entries, {"id": "string"}, ENTRY).where("id is not null")
        entries = entries.groupBy("id").agg(F.max(F.struct("updated_at", *[c for c in ENTRY if c != "updated_at"])).alias("e")).select("id", "e.*")
        messages = _shaped(messages, {"id": "string"}, MESSAGE).groupBy("id", "seq").agg(F.max(F.struct("role", "text")).alias("m")).select("id", "seq", "m.*")
        bodies = messages.select("id").distinct()
        tables = {"entries": entries.join(bodies, "id", "left_semi"), "messages": messages.join(entries.select("id"), "id", "left_semi")}
        if labels is not None:
            tables["labels"] = _labels(labels).join(tables["entries"].select("id"), "id", "left_semi")
        if registry is not None:
            tables["registry"] = _shaped(registry, {}, {"label": "string", "color": "string"}).distinct()
        return self.commit(tables, expected, ["registry"] if registry is not None else [])

    def relabel(self, labels: DataFrame, expected: int | None = None) -> int:
        """labels: id, labels (an array; empty takes all labels off). Ids that are not there are left out."""
        return self.commit({"labels": _labels(labels).join(self.entries().select("id"), "id", "left_semi")}, expected)

    def delete(self, ids: DataFrame, expected: int | None = None) -> int:
        return self.commit({"gone": ids.select(F.col("id").cast("string").alias("id")).distinct()}, expected)

    def _last(self, table: str, columns: dict) -> DataFrame:
        """The last row of each id that no later deletion hides, with its revision."""
        rows = self.read(table)
        if rows is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ({"id": "string"} | columns | {"revision": "int"}).items()))
        last = rows.groupBy("id").agg(F.max_by(F.struct(*columns, "revision"), "revision").alias("r")).select("id", "r.*")
        gone = self.read("gone")
        if gone is None:
            return last
        gone = gone.groupBy("id").agg(F.max("revision").alias("__gone"))
        return last.join(gone, "id", "left").where(F.col("__gone").isNull() | (F.col("revision") > F.col("__gone"))).drop("__gone")

    def entries(self) -> DataFrame:
        labels = self._last("labels", {"labels": "array<string>"}).drop("revision")
        rows = self._last("entries", ENTRY).drop("revision").join(labels, "id", "left")
        return rows.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))

    def messages(self) -> DataFrame:
        rows = self.read("messages")
        if rows is None:
            return self.spark.createDataFrame([], "id string, seq long, role string, text string")
        return rows.join(self._last("entries", ENTRY).select("id", "revision"), ["id", "revision"], "left_semi").drop("revision")

    def registry(self) -> DataFrame:
        rows = self.read("registry")
        return self.spark.createDataFrame([], "label string, color string") if rows is None else rows.drop("revision")

    def export(self, path: str, ids: DataFrame | None = None) -> None:
        """Entries, messages and the registry as JSON lines in three folders; all conversations, or those of ``ids`` (id)."""
        entries, messages = self.entries(), self.messages()
        if ids is not None:
            entries, messages = (x.join(ids.select("id"), "id", "left_semi") for x in (entries, messages))
        for name, rows in (("entries", entries), ("messages", messages), ("registry", self.registry())):
            rows.write.mode("overwrite").option("timestampFormat", TIMES).json(f"{path}/{name}")

    def import_(self, path: str, expected: int | None = None) -> int:
        """Save what was exported, in one commit: a commit that dies leaves everything as it was."""
        read = lambda name, columns: self.spark.read.schema(", ".join(f"{c} {t}" for c, t in columns.items())).option("timestampFormat", TIMES).json(f"{path}/{name}")
        entries = read("entries", {"id": "string"} | ENTRY | {"labels": "array<string>"})
        labels = entries.where(F.size("labels") > 0).select("id", "labels")
        return self.save(entries, read("messages", {"id": "string"} | MESSAGE), expected, labels, read("registry", {"label": "string", "color": "string"}))

    def compact(self) -> int:
        """One commit of what is there, in place of all."""
        now, entries = self.revision(), self.entries()
        tables = {"entries": entries.drop("labels"), "messages": self.messages(), "labels": entries.select("id", "labels"), "registry": self.registry()}
        return self.commit(tables, now, [*tables, "gone"])


def _labels(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("id").cast("string").alias("id")).agg(F.max(F.array_distinct("labels")).alias("labels"))
