"""Services that answer in pages, as Spark data sources: what the service can filter is sent to it, and pages are read as they are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains

from . import files

#: conditions that a service may take, by the names that it gets
SENT = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", StringContains: "contains"}

#: asks for one page: (conditions, page token or None, page size) to (rows, next token or None)
Fetch = Callable[[list, object, int], tuple[list, object]]


def _pages(fetch: Fetch, sent: list, size: int, cap: int | None = None):
    """Rows of page after page; a page's token comes with the page before it."""
    token, given = None, 0
    while True:
        rows, token = fetch(sent, token, size)
        for row in rows:
            if cap is not None and given >= cap:
                return
            given += 1
            yield tuple(row)
        if token is None or not rows:
            return


class _Range(InputPartition):
    """Marks above lo, up to hi; None for no bound."""

    def __init__(self, lo: int | None, hi: int | None):
        super().__init__(0)
        self.lo, self.hi = lo, hi

    def conditions(self, mark: str) -> list:
        return [(mark, name, at) for name, at in (("gt", self.lo), ("le", self.hi)) if at is not None]


def _ranges(lo: int, hi: int, n: int) -> list[_Range]:
    cuts = sorted({lo + (hi - lo) * k // n for k in range(n + 1)})
    return [_Range(a, b) for a, b in zip(cuts, cuts[1:])]


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, able: frozenset, size: int, cap: int | None, order: tuple[str, str] | None, marks: tuple[str, int, int, int] | None):
        self.fetch, self.able, self.size, self.cap, self.order, self.marks = fetch, able, size, cap, order, marks
        self.sent = []

    def pushFilters(self, filters):
        for f in filters:
            name = SENT.get(type(f))
            if name and (f.attribute[0], name) in self.able:
                self.sent.append((f.attribute[0], name, f.value))
            else:
                yield f

    def partitions(self):
        return _ranges(*self.marks[1:]) if self.marks else [_Range(None, None)]

    def read(self, partition):
        sent = self.sent + partition.conditions(self.marks[0]) if self.marks else list(self.sent)
        yield from _pages(self.fetch, sent + ([(self.order[0], "order", self.order[1])] if self.order else []), self.size, self.cap)


class _StreamReader(DataSourceStreamReader):
    """Offsets are marks: a batch is the rows whose mark is above the last batch's, up to the largest when it was planned."""

    def __init__(self, fetch: Fetch, latest: Callable[[], int], mark: str, first: int, size: int, parts: int):
        self.fetch, self.latest, self.mark, self.first, self.size, self.parts = fetch, latest, mark, first, size, parts

    def initialOffset(self):
        return {"mark": self.first}

    def latestOffset(self):
        return {"mark": max(self.first, self.latest())}

    def partitions(self, start, end):
        return _ranges(start["mark"], end["mark"], self.parts)

    def read(self, partition):
        yield from _pages(self.fetch, partition.conditions(self.mark), self.size)


def paged(
    spark: SparkSession, name: str, schema: str, fetch: Fetch, able: list[tuple[str, str]] = (), size: int = 50, cap: int | None = None,
    order: tuple[str, str] | None = None, marks: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """Rows of a service. able: (column, condition) pairs that it filters by itself; the rest is filtered here.

    order: (column, asc or desc) that the service is asked to answer in, so that ``cap``, the listing's own limit of rows,
    keeps the first ones. marks: (column, above, up to, parts) of a whole-numbered column reads ranges of it side by
    side, each page by page; the service must take gt and le on it. A cap then holds for each range.
    """
    able, cls_schema = frozenset(able), schema

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return cls_schema

        def reader(self, schema):
            return _Reader(fetch, able, size, cap, order, marks)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


def paged_stream(spark: SparkSession, name: str, schema: str, fetch: Fetch, latest: Callable[[], int], mark: str, first: int = 0, size: int = 50, parts: int = 4) -> DataFrame:
    """A stream of a service's rows by a whole-numbered mark that only grows, such as the time of receipt in milliseconds.

    ``latest`` asks for the largest mark. What a batch reads is in the stream's own log before it is read: a stream that
    was stopped reads the same range again, and the next one begins where it ended. Ranges of marks are read side by side.
    """
    cls_schema = schema

    class PagedStream(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return cls_schema

        def streamReader(self, schema):
            return _StreamReader(fetch, latest, mark, first, size, parts)

    spark.dataSource.register(PagedStream)
    return spark.readStream.format(name).load()


def keep_new(target: str, key: str):
    """A foreachBatch function that appends rows whose key is not in ``target`` yet; of rows of one key in a batch one is taken.

    A batch is a folder named by its epoch, so one that is repeated is written over. ``kept`` reads the table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        known = kept(batch.sparkSession, target, epoch)
        rows = batch.dropDuplicates([key])
        if known is not None:
            rows = rows.join(known.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def kept(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The rows of epochs below ``before``, or of all; None without any."""
    epochs = [int(p.rsplit("=", 1)[1]) for p in files.listed(spark, target) if "epoch=" in p]
    paths = [f"{target}/epoch={e}" for e in epochs if before is None or e < before]
    return spark.read.parquet(*paths) if paths else None
