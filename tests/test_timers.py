"""Streams with timers against their batch forms, and paged services that are read on after a stop."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.sources.paged import keep_new, kept, paged, paged_stream
from cairn.streaming import streams

BEGIN = datetime(2026, 3, 1)
SCHEMA = "k string, t timestamp, busy boolean"


class Feed:
    """A stream of Parquet files, run batch by batch over one checkpoint."""

    def __init__(self, spark, path, made):
        self.spark, self.path, self.made, self.n = spark, path, made, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        """Read what is new, and what the timers say; the number of keys in the state."""
        source = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
        q = self.made(source).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return state[-1] if state else None

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.path}/out").collect()))


def events(rnd, n, hours):
    """Batches of events, out of order within nine minutes."""
    at = sorted(rnd.randrange(hours * 3600) for _ in range(n))
    rows = [(f"k{rnd.randrange(4)}", BEGIN + timedelta(seconds=s, microseconds=rnd.randrange(3)), rnd.random() < 0.4) for s in at]
    arrive = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.randrange(540)))
    return [arrive[i : i + n // 3] for i in range(0, n, n // 3)]


END = BEGIN + timedelta(days=2)


@pytest.mark.parametrize("made, plain", [
    (lambda s: streams.cooldown_stream(s, "k", "t", 30), lambda d: streams.fire_with_cooldown(d, "k", "t", 30).select("k", F.unix_micros("t"))),
    (lambda s: streams.deferred_stream(s, "k", "t", "busy", 5), lambda d: streams.deferred_runs(d, "k", "t", "busy", 5).select("k", F.unix_micros("t"), "status")),
])
def test_stream_and_batch_agree(spark, tmp_path, made, plain):
    """Events out of order say what they say in order; a stop between batches loses nothing; the state empties."""
    parts = events(random.Random(8), 60, 6)
    feed = Feed(spark, str(tmp_path), made)
    most = 0
    for rows in parts:
        feed.put(rows)
        most = max(most, feed.run() or 0)
    feed.put([("end", END, False)])
    feed.run()
    feed.put([("end", END + timedelta(hours=3), False)])
    left = feed.run()
    every = spark.createDataFrame([r for rows in parts for r in rows], SCHEMA)
    got = [r for r in feed.rows() if r[0] != "end"]
    assert got == sorted(map(tuple, plain(every).collect()))
    assert most >= 2 and left <= 1  # the last event waits for the watermark


def test_deferred_runs(spark):
    at = lambda m: BEGIN + timedelta(minutes=m)
    rows = [("a", at(0), True), ("a", at(5), False), ("a", at(20), True), ("a", at(24), True), ("b", at(1), None), ("c", None, True)]
    got = streams.deferred_runs(spark.createDataFrame(rows, SCHEMA), "k", "t", "busy").collect()
    assert sorted((r.k, (r.t - BEGIN).seconds // 60, r.status) for r in got) == [
        ("a", 0, "deferred"), ("a", 5, "run"), ("a", 20, "deferred"), ("a", 24, "deferred"), ("a", 29, "retried"), ("b", 1, "run"),
    ]


def service(path):
    """A mailbox in a file: pages of messages whose mark lies in a range, and its largest mark."""

    def rows():
        with open(path) as f:
            return json.load(f)

    def fetch(sent, token, size):
        lo = max([v for c, n, v in sent if n == "gt"], default=-1)
        hi = min([v for c, n, v in sent if n == "le"], default=10**9)
        inside = sorted((r for r in rows() if lo < r[2] <= hi), key=lambda r: (r[2], r[0]))
        if any(n == "order" and v == "desc" for _, n, v in sent):
            inside.reverse()
        at = token or 0
        if any(r[1] == "poison" for r in inside[at : at + size]):
            raise OSError("the service is away")
        return inside[at : at + size], at + size if at + size < len(inside) else None

    return fetch, lambda: max((r[2] for r in rows()), default=0)


def test_paged_ranges_and_order(spark, tmp_path):
    box = [(f"m{i}", f"subject {i}", i * 7 % 100) for i in range(60)]
    (tmp_path / "box").write_text(json.dumps(box))
    fetch, _ = service(str(tmp_path / "box"))
    schema = "id string, subject string, received long"
    df = paged(spark, "mail_ranges", schema, fetch, size=4, marks=("received", 9, 80, 5))
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == sorted(r for r in box if 9 < r[2] <= 80)
    newest = paged(spark, "mail_newest", schema, fetch, size=4, cap=10, order=("received", "desc"))
    assert [tuple(r) for r in newest.collect()] == sorted(box, key=lambda r: (-r[2], r[0]))[:10]


def test_paged_stream_goes_on(spark, tmp_path):
    """Stopped by a failing service in the middle of a range, the stream gives each message once in the end."""
    box, file = [(f"m{i}", "s", i + 1) for i in range(25)], tmp_path / "box"
    file.write_text(json.dumps(box))
    fetch, latest = service(str(file))
    target = f"file://{tmp_path}/table"

    def run():
        s = paged_stream(spark, "mail_stream", "id string, subject string, received long", fetch, latest, "received", size=3, parts=3)
        q = s.writeStream.foreachBatch(keep_new(target, "id")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert kept(spark, target).count() == 25
    file.write_text(json.dumps([*box, *[(f"m{i}", "s", i + 1) for i in range(25, 40)], ("bad", "poison", 38)]))
    with pytest.raises(Exception, match="away"):
        run()
    later = [*box, *[(f"m{i}", "s", i + 1) for i in range(25, 50)], ("m3", "edited", 49)]
    file.write_text(json.dumps(later))
    run()
    run()
    got = [r.id for r in kept(spark, target).collect()]
    assert len(got) == 50 and set(got) == {f"m{i}" for i in range(50)}
