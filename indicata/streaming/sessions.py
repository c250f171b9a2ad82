"""Session logs as a stream: state with a bounded list of calls, counts by API, and event-time timers.

A session begins with its first call and takes all calls of its id within the time limit after it;
a later call begins a new session. A session's state goes when a later call or the watermark passes
its end. State is kept by Spark's state store for stateful processors (RocksDB), in as many partitions as
the stream has; it grows with the sessions that are open, each of which holds ``RING`` calls at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .calls import SESSION_TTL

#: Calls of a session that its state lists.
RING = 5
OUT = "session_id string, first_us long, total long, violations long, apis string, recent string, expired boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
FALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionLog(StatefulProcessor):
    """Running logs of sessions: a row for each session that a batch touches, and one, expired, when it ends."""

    def __init__(self, ttl: int = SESSION_TTL, ring: int = RING):
        self.ttl, self.ring = ttl, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "first_us long, total long, violations long")
        self.recent = handle.getListState("recent", "us long, api string")
        self.by_api = handle.getMapState("by_api", "api string", "calls long")

    def _load(self) -> tuple:
        if not self.totals.exists():
            return None, 0, 0, {}, []
        return (*self.totals.get(), {k[0]: v[0] for k, v in self.by_api.iterator()}, sorted(self.recent.get()))

    def _clear(self) -> None:
        for state in (self.totals, self.recent, self.by_api):
            state.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    @staticmethod
    def _row(key: tuple, first: int, total: int, bad: int, apis: dict, ring: list, expired: bool) -> tuple:
        return key[0], first, total, bad, ",".join(f"{k}={n}" for k, n in sorted(apis.items())), ",".join(api for _, api in ring), expired

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["us", "api"], kind="stable")
        first, total, bad, apis, ring = held = self._load()
        out, fresh, touched = [], first is None, set()
        for us, api, violation in zip(calls["us"].tolist(), calls["api"].tolist(), calls["violation"].tolist()):
            if first is not None and us > first + self.ttl * 1_000_000:
                out.append(self._row(key, first, total, bad, apis, ring, True))
                first, total, bad, apis, ring, fresh = None, 0, 0, {}, [], True
            first = us if first is None else first
            total, bad = total + 1, bad + bool(violation)
            apis[api] = apis.get(api, 0) + 1
            touched.add(api)
            ring = sorted([*ring, (us, api)])[-self.ring :]
        # only the session that is open now is written: those that ended within the rows never get state
        if fresh:
            if held[0] is not None:
                self._clear()
            touched = set(apis)
            self.handle.registerTimer((first + self.ttl * 1_000_000) // 1000 + 1)
        self.totals.update((first, total, bad))
        self.recent.put(ring)
        for api in touched & set(apis):
            self.by_api.updateValue((api,), (apis[api],))
        out.append(self._row(key, first, total, bad, apis, ring, False))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            row = self._row(key, *self._load(), True)
            self._clear()
            yield pd.DataFrame([row], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def session_logs(calls: DataFrame, ttl: int = SESSION_TTL, ring: int = RING, late: str = "10 minutes") -> DataFrame:
    """The stream of session logs of a stream of calls (ts, session_id, api, violation).

    Calls later than ``late`` behind the latest are dropped by the watermark; calls without a session id
    or a time are none. The session needs the state store ``ROCKS`` when the stream starts.
    """
    stream = calls.where("session_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    stream = stream.select("session_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("api", F.lit("")).alias("api"), F.coalesce("violation", F.lit(False)).alias("violation"))
    logs = stream.groupBy("session_id").transformWithStateInPandas(SessionLog(ttl, ring), OUT, "Update", "EventTime")
    return logs.select("session_id", F.timestamp_micros("first_us").alias("first_ts"), "total", "violations", "apis", "recent", "expired")


def run_to_end(stream: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Runs the stream over all that there is now and gives its rows, which are written below ``folder``; a shared one on a cluster.

    ``partitions`` are those of the stream's state, which stay as they are at its first start.
    """
    spark = stream.sparkSession
    held = {k: spark.conf.get(k, None) for k in (STORE, FALLOCATE, "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set(STORE, ROCKS)
        # else each partition's store takes megabytes of disk for a log that is nearly empty
        spark.conf.set(FALLOCATE, "false")
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def last_logs(rows: DataFrame) -> DataFrame:
    """The last state of each session among its rows."""
    state = F.struct("expired", "total", "violations", "apis", "recent")
    return rows.groupBy("session_id", "first_ts").agg(F.max(state).alias("s")).select("session_id", "first_ts", "s.total", "s.violations", "s.apis", "s.recent", "s.expired")
