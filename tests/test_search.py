from pyspark.sql import functions as F

from cairn.operators import records
from cairn.sources import search
from cairn.sources.readers import new_since


def test_search(spark):
    mail = spark.createDataFrame([(1, "Ann <a@x>", "Budget plan", "2024-01-02"), (2, "Bob", "budget", "2024-02-01"), (3, "Ann", "Lunch", "2024-01-03")], "id int, sender string, subject string, d string")
    mail = mail.withColumn("received", F.col("d").cast("timestamp"))
    where = search.mail_filter("ann", "BUDGET", "2024-01-01", "2024-02-01")
    assert [r.id for r in mail.where(where).collect()] == [1]
    files = spark.createDataFrame([(1, "Plan.docx", "/a/b", "2024-01-01"), (2, "plan.pdf", "/a/c", "2024-01-05"), (3, "x.txt", "/z", "2024-01-01")], "id int, name string, path string, d string")
    files = files.withColumn("mtime", F.col("d").cast("timestamp"))
    assert [r.id for r in files.where(search.file_filter("plan", ["PDF", ".docx"], "/a", "2024-01-02")).collect()] == [2]
    both = search.fan_out(mail, files, F.lit(True), search.file_filter("plan"))
    assert sorted((r.kind, r.pos, r.id) for r in both.collect()) == [("file", 1, 2), ("file", 2, 1), ("mail", 1, 2), ("mail", 2, 3), ("mail", 3, 1)]
    assert search.library(files, ["txt"]).count() == 1
    mark = search.high_water(mail, "received")
    assert [r.id for r in new_since(mail, mail.where("id = 9"), "id", "received", mark).collect()] == [2]
    cal = spark.createDataFrame([(1, "Team sync", "Room", "ann bob", "2024-01-01 09:00", "2024-01-01 10:00"), (2, "Team", "Hall", "ann", "2024-01-03 09:00", "2024-01-03 10:00")], "id int, subject string, place string, people string, s string, e string")
    cal = cal.select("id", "subject", "place", "people", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    assert [r.id for r in search.calendar_search(cal, "2024-01-01", "2024-01-04", "team ANN").collect()] == [1, 2]
    assert [r.id for r in search.calendar_search(cal, "2024-01-01", "2024-01-02", "bob").collect()] == [1]
    r = spark.range(1).select(search.without_markup(F.lit("a <c0>b</c0> <ddd/> c")).alias("x"), search.claim_name(F.lit("i:0#.f|m|ann@x")).alias("y")).first()
    assert (r.x, r.y) == ("a b … c", "ann@x")


def test_states(spark):
    j = spark.createDataFrame([("queued", "start"), ("paused", "start"), ("done", "start"), ("running", "pause"), ("running", "cancel"), ("done", "cancel")], "s string, c string")
    assert [r.x for r in j.select(records.job_transition(F.col("s"), F.col("c")).alias("x")).collect()] == ["running", "running", "done", "paused", "cancelled", "done"]
    c = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    n = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None)], "key string, value string")
    assert [tuple(r) for r in records.config_diff(c, n).collect()] == [("b", "2", "3")]
    k = spark.createDataFrame([("x",), ("y",)], "tool string")
    look = spark.createDataFrame([("x", "read")], "tool string, action string")
    assert sorted(map(tuple, records.classify(k, look, "tool", "write").collect())) == [("x", "read"), ("y", "write")]
