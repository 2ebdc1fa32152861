"""Stateful flows as Structured Streaming.

``resolve`` follows each key (repo, revision, path) from request to answer; its transition rule is a pure function that
batch tests replay. ``quiet`` closes bursts of touches. ``put_stream`` commits index entries, first writer wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import quiet_sessions
from ..operators.dedup import put_if_absent

STATE = "status string, etag string, checked long, failures long, next_retry long"
OUT = "key string, ord long, at long, answer string, failures long"
IDLE, FLIGHT, READY = "idle", "in_flight", "ready"


def transition(state: tuple, kind: str, at: int, etag: str | None, revalidate: int) -> tuple[tuple, str]:
    """(status, etag, checked, failures, next_retry) and an event give the next state and the answer.

    request: starts one download per key, waits for one under way, is served from what is held, is refused while a failure's
    back-off lasts; a held entry that is due is revalidated. done / failed end a download. probe: the upstream's tag; another
    one drops the entry, a missing one (an error) keeps it.
    """
    status, tag, checked, failures, retry = state
    if kind == "request":
        if status == READY:
            due = revalidate == 0 or revalidate > 0 and checked + revalidate <= at
            return state, "revalidate" if due else "ready"
        if status == FLIGHT:
            return state, "wait"
        if retry > at:
            return state, "backoff"
        return (FLIGHT, tag, checked, failures, retry), "start"
    if kind == "done":
        return (READY, etag, at, 0, 0), "stored"
    if kind == "failed":
        n = failures + 1
        return (IDLE, tag, checked, n, at + min(10 * 2 ** min(n - 1, 6), 600)), "failed"
    if kind == "probe" and status == READY:
        if etag is None:
            return state, "kept"
        if etag != tag:
            return (IDLE, None, 0, 0, 0), "dropped"
        return (READY, tag, at, failures, retry), "valid"
    return state, "ignored"


START = (IDLE, None, 0, 0, 0)


def replay(events: list[tuple], revalidate: int = 300) -> list[tuple]:
    """Answers for one key's events (ord, kind, at, etag) in order: the plain version of resolve."""
    state, out = START, []
    for ord_, kind, at, etag in events:
        state, answer = transition(state, kind, at, etag, revalidate)
        out.append((ord_, at, answer, state[3]))
    return out


def resolve(events: DataFrame, revalidate: int = 300) -> DataFrame:
    """key, ord, at, answer, failures for a stream of events (key, ord, kind, at, etag). State is five values a key."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for ord_, kind, at, etag in rows[["ord", "kind", "at", "etag"]].itertuples(index=False, name=None):
            now, answer = transition(now, kind, int(at), etag if isinstance(etag, str) else None, revalidate)
            out.append((key[0], ord_, at, answer, now[3]))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "ord", "at", "answer", "failures"])

    return events.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def quiet(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of touches (container, ts), each given out once its key has been quiet for the gap."""
    return quiet_sessions(events.withWatermark("ts", late), gap)


def put_stream(writes: DataFrame, table: str, checkpoint: str):
    """Appends the first write of each new key of a stream (key, value, ord) to a Parquet table. A batch that is run again
    finds its keys there, so commits are idempotent."""

    def commit(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        # Only a table that is not there yet is empty: any other failure to read it must not lose a first writer.
        new = not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        there = spark.createDataFrame([], batch.select("key").schema) if new else spark.read.parquet(table).select("key")
        put_if_absent(there, batch).where("inserted").select("key", "value").write.mode("append").parquet(table)

    return writes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Beyond the reference: counts by event-time window, with late data up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("opened"), "event_type", "n")
