"""Live request flows as Structured Streaming jobs; each gives the rows of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.requests import blocked_updates, decide_requests
from ..sources.files import read_rule_sets, rule_tables

LATE = "10 seconds"
SILENCE_MS = 3_600_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PerTab(StatefulProcessor):
    """Rows of a tab in order of time, and typed state that goes when event time is an hour past the tab's last row.

    A timer stands at the end of that hour; when it is due and rows came since, it is set anew.
    """

    order = ["ts"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def each(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(self.order)
        if not len(own):
            return
        now = int(own["ts"].max().timestamp() * 1000)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, now + SILENCE_MS))
        self.last.update((max(now, before or now),))
        yield self.each(key, own)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.last.get()[0] + SILENCE_MS if self.last.exists() else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.last.clear()
            self.forget()
        return iter(())

    def close(self) -> None:
        pass


def _by_tab(rows: DataFrame, job: PerTab, schema: str, mode: str) -> DataFrame:
    """State lies in RocksDB, which typed state needs; the session is told so."""
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return rows.withWatermark("ts", LATE).groupBy("tab_id").transformWithStateInPandas(job, schema, mode, "EventTime")


def decide_requests_stream(stream: DataFrame, rules_path: str, out_path: str, checkpoint: str, filters: DataFrame | None = None, allowlist: DataFrame | None = None):
    """Decide each micro-batch by the rule sets as they are on disk at that moment; a batch has its own folder in ``out_path``, so one that is repeated replaces itself."""

    def decide(batch: DataFrame, number: int) -> None:
        match, redirect, block = rule_tables(read_rule_sets(batch.sparkSession, rules_path)[0])
        decide_requests(batch, match, redirect, block, filters, allowlist).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TabCounters(PerTab):
    """Three numbers a tab."""

    order = ["ts", "event_id"]

    def prepare(self, handle):
        self.held = handle.getValueState("counters", "nav long, requests long, blocked long")

    def each(self, key, rows):
        nav, requests, blocked = self.held.get() if self.held.exists() else (0, 0, 0)
        out = {}
        for navigation, cut in zip(rows["navigation"], rows["blocked"]):
            if navigation:
                nav, requests, blocked = nav + 1, 0, 0
            else:
                requests, blocked = requests + 1, blocked + int(cut)
                out[nav] = (requests, blocked)
        self.held.update((nav, requests, blocked))
        return pd.DataFrame([(key[0], n, r, b) for n, (r, b) in out.items()], columns=["tab_id", "nav_no", "requests", "blocked"])

    def forget(self):
        self.held.clear()


def tab_counters_stream(events: DataFrame) -> DataFrame:
    """(tab_id, nav_no, requests, blocked) after each batch; a navigation starts new counters. State is three numbers per tab and goes when event time is an hour past the tab's last event; rows later than ten seconds may be dropped."""
    return _by_tab(events, TabCounters(), "tab_id long, nav_no long, requests long, blocked long", "Update")


def blocked_updates_stream(events: DataFrame, every: str = "600 milliseconds", key: str | None = None, observed: str | None = None) -> DataFrame:
    """One update per tab and window; rows later than ten seconds are dropped.

    With ``key``, a row that comes again within ten seconds of event time counts once. ``observed`` names metrics of each
    batch, for a listener: rows, rows that are blocked, and those that are late by the clock of the batch itself.
    """
    if observed:
        late = F.sum((F.col("ts") < F.current_timestamp() - F.expr(f"interval {LATE}")).cast("long"))
        events = events.observe(observed, F.count("*").alias("rows"), F.sum(F.col("blocked").cast("long")).alias("blocked"), late.alias("late"))
    marked = events.withWatermark("ts", LATE)
    return blocked_updates(marked if key is None else marked.dropDuplicatesWithinWatermark([key]), every)


class DocumentChanges(PerTab):
    """Each tab's last path and title."""

    order = ["ts", "nav_id"]

    def prepare(self, handle):
        self.held = handle.getValueState("shown", "path string, title string")

    def each(self, key, rows):
        last, out = (tuple(self.held.get()) if self.held.exists() else None), []
        paths = rows["url"].str.replace(r"[?#].*$", "", regex=True).str.replace(r"/page/\d+/?$", "/", regex=True)
        for nav_id, path, title in zip(rows["nav_id"], paths, rows["title"]):
            if last != (path, title):
                out.append((key[0], nav_id, title))
            last = (path, title)
        self.held.update(last)
        return pd.DataFrame(out, columns=["tab_id", "nav_id", "title"])

    def forget(self):
        self.held.clear()


def document_changes_stream(navigations: DataFrame) -> DataFrame:
    """Navigations that bring a new document; state is each tab's last path and title, and goes an hour of event time after the tab's last one."""
    return _by_tab(navigations, DocumentChanges(), "tab_id long, nav_id long, title string", "Append")


class RecentLog(PerTab):
    """The last ids, and the time of the last row, as one value: a tab costs one read and one write a batch."""

    order = ["ts", "request_id"]

    def __init__(self, n: int):
        self.n = n

    def init(self, handle):
        self.handle = handle
        self.held = handle.getValueState("held", "ms long, ids array<long>")

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        stamps = np.concatenate([p["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for p in parts])
        ids = np.concatenate([p["request_id"].to_numpy() for p in parts])
        if not len(ids):
            return
        now = int(stamps.max() // 1000)
        before = self.held.get()
        if before is None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, now + SILENCE_MS))
        last, old = before or (now, [])
        kept = [*old, *ids[np.lexsort((ids, stamps))[-self.n :]].tolist()][-self.n :]
        self.held.update((max(now, last), kept))
        yield pd.DataFrame({"tab_id": [key[0]], "ids": [kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.held.get()
        due = held[0] + SILENCE_MS if held else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.held.clear()
        return iter(())


def recent_log_stream(requests: DataFrame, n: int = 400) -> DataFrame:
    """(tab_id, ids): the ids of each tab's last ``n`` requests after a batch, newest last; state is that list, and goes an hour of event time after the last request."""
    return _by_tab(requests, RecentLog(n), "tab_id long, ids array<long>", "Update")


def run_available(frame: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its rows with their batch, written to ``folder``; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    frame.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in frame.dtypes)}, batch long").parquet(f"{folder}/rows")


def to_memory(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and give its result as a table; for tests and small jobs."""
    running = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return frame.sparkSession.table(name)


def stream_of(spark, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
