"""Stateful and streaming operators: cooldown firing, sessions, change capture, incremental pulls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files


def fire_with_cooldown(events: DataFrame, key: str, ts: str, minutes: int = 60) -> DataFrame:
    """Events that fire: each at least ``minutes`` after the last one that fired for its key.

    Firing depends on the last fired event, so each key is folded in order of time; a key's times are
    read as sorted batches of one partition, never gathered as a group.
    """
    wait = minutes * 60_000_000
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us is not null")
    rows = rows.repartition("key").sortWithinPartitions("key", "us")

    def fold(batches):
        at, last = None, None
        for pdf in batches:
            out = []
            for k, us in zip(pdf["key"], pdf["us"]):
                if k != at:
                    at, last = k, None
                fires = last is None or us - last >= wait
                if fires:
                    last = us
                out.append(fires)
            yield pdf[out]

    got = rows.mapInPandas(fold, rows.schema)
    return got.select(F.col("key").alias(key), F.timestamp_micros("us").cast(events.schema[ts].dataType).alias(ts))


def _in_time(events: DataFrame, key: str, ts: str, late: str, fold, due, fall, flag: Column | None = None) -> DataFrame:
    """key, us, said: what a fold over each key's events says, in order of time however they arrive, and what its timers say.

    An event waits until the watermark has passed it, then ``fold`` (memory, us, flag) gives (memory, rows said). ``due``
    (memory) is the time at which a key's timer goes off, or None; ``fall`` (memory) is the fold of a timer. A key that
    waits for nothing and has no timer leaves the state, so the state holds keys of the last while only.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, pdfs, state: GroupState):
        memory, waiting = None, []
        if state.exists:
            memory, times, flags = state.get
            waiting = list(zip(times, flags))
        if not state.hasTimedOut:
            waiting += [(int(us), bool(f)) for pdf in pdfs for us, f in zip(pdf["us"], pdf["flag"])]
        mark = state.getCurrentWatermarkMs()
        said: list[tuple[int, str]] = []

        def until(us: int) -> None:
            nonlocal memory
            while due(memory) is not None and due(memory) < us:
                memory, rows = fall(memory)
                said.extend(rows)

        ready = sorted(x for x in waiting if x[0] < mark * 1000)
        for us, f in ready:
            until(us)
            memory, rows = fold(memory, us, f)
            said.extend(rows)
        until(mark * 1000)
        waiting = sorted(x for x in waiting if x[0] >= mark * 1000)
        times = [x for x in (due(memory), waiting[0][0] if waiting else None) if x is not None]
        if times:
            state.update((memory, [us for us, _ in waiting], [f for _, f in waiting]))
            state.setTimeoutTimestamp(max(min(times) // 1000, mark) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [k[0]] * len(said), "us": [us for us, _ in said], "said": [x for _, x in said]})

    rows = events.withWatermark(ts, late).where(F.col(ts).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), ts, (F.lit(False) if flag is None else flag).alias("flag"))
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, us long, said string", "memory long, times array<long>, flags array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )


def cooldown_stream(events: DataFrame, key: str, ts: str, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, us of the events that fire, as in ``fire_with_cooldown``, over a stream whose events come up to ``late`` out of order.

    The state of a key is the last time that it fired; it goes when the cooldown is over.
    """
    wait = minutes * 60_000_000

    def fold(last, us, _):
        return (us, [(us, "fired")]) if last is None or us - last >= wait else (last, [])

    return _in_time(events, key, ts, late, fold, lambda last: None if last is None else last + wait - 1, lambda _: (None, [])).drop("said")


def deferred_runs(due: DataFrame, key: str, ts: str, busy: str, minutes: int = 5) -> DataFrame:
    """key, ts, status of runs that are due: run, or deferred where the runner is busy, and then retried after ``minutes``.

    A retry is dropped if the task is due again before it.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = due.select(F.col(key).alias("key"), us.alias("us"), F.coalesce(F.col(busy), F.lit(False)).alias("busy")).where("us is not null")
    # of runs of one time the busy one is the later
    rows = rows.withColumn("next", F.lead("us").over(W.partitionBy("key").orderBy("us", "busy")))
    later = F.col("us") + minutes * 60_000_000
    again = F.col("busy") & (F.col("next").isNull() | (F.col("next") > later))
    said = F.array_compact(F.array(F.struct("us", F.when(F.col("busy"), "deferred").otherwise("run").alias("status")), F.when(again, F.struct(later.alias("us"), F.lit("retried").alias("status")))))
    return rows.select("key", F.explode(said).alias("r")).select(F.col("key").alias(key), F.timestamp_micros("r.us").alias(ts), "r.status")


def deferred_stream(due: DataFrame, key: str, ts: str, busy: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """key, us, status: the same over a stream. A deferred run is a timer of its key; a key without one keeps no state."""
    wait = minutes * 60_000_000

    def fold(_, us, is_busy):
        return (us + wait, [(us, "deferred")]) if is_busy else (None, [(us, "run")])

    said = _in_time(due, key, ts, late, fold, lambda at: at, lambda at: (None, [(at, "retried")]), F.coalesce(F.col(busy), F.lit(False)))
    return said.withColumnRenamed("said", "status")


def quiet_sessions(events: DataFrame, key: str, ts: str, gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """Bursts with no pause of ``gap``: key, first and closing time, events. With ``late``: a watermark, for streams."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")


def windowed_counts(events: DataFrame, ts: str, width: str, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), key, "n")


#: Epochs between two whole states of a table of changes.
SNAPSHOTS = 20


def apply_changes(target: str, key: str, compare: list[str], order: str | None = None):
    """A foreachBatch function that keeps a table of changes in ``target``: each batch adds what is new, changed or removed.

    A batch is named by its epoch, so one that is repeated writes the same changes again. Of rows with one key the
    last by ``order`` counts, else the largest by the compared columns. A row whose column ``removed`` is true
    takes its key out. Rows that are the same in the compared columns are not written. ``changed_state`` reads it.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in batch.columns else F.lit(False)
        rows = batch.withColumn("removed", gone)
        last = F.struct(*([order] if order else []), *compare, "removed")
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), last).alias("r")).select(key, "r.*")
        before = changed_state(spark, target, key, epoch)
        if before is None:
            rows = rows.where("not removed")
        else:
            had = before.select(key, F.struct(*compare).alias("__had"))
            same = F.col("__had").eqNullSafe(F.struct(*compare))
            rows = rows.join(had, key, "left").where(F.when(F.col("removed"), F.col("__had").isNotNull()).otherwise(F.col("__had").isNull() | ~same)).drop("__had")
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
        if epoch % SNAPSHOTS == SNAPSHOTS - 1:
            changed_state(spark, target, key, epoch + 1).write.mode("overwrite").parquet(f"{target}/state={epoch}")

    return merge


def changed_state(spark, target: str, key: str, before: int | None = None) -> DataFrame | None:
    """The table that the changes make, of epochs below ``before`` if given; None without any.

    Reads the last whole state that was written, and the changes after it: SNAPSHOTS epochs at most.
    """
    listed = files.listed(spark, target)
    of = lambda name: sorted(e for e in (int(p.rsplit("=", 1)[1]) for p in listed if f"/{name}=" in p) if before is None or e < before)
    epochs, states = of("epoch"), of("state")
    states = [e for e in states if files.exists(spark, f"{target}/state={e}/_SUCCESS")]
    if not epochs:
        return None
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/epoch={e}" for e in epochs if not states or e > states[-1]] or [f"{target}/epoch={epochs[-1]}"])
    if states:
        rows = rows.unionByName(spark.read.parquet(f"{target}/state={states[-1]}").withColumns({"removed": F.lit(False), "epoch": F.lit(states[-1])}))
    rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "epoch")]), "epoch").alias("r"))
    return rows.select(key, "r.*").where("not removed").drop("removed")
