"""Exact admission of requests: so many in any window of time, refused ones take no slot. For logs, for streams by event time, and for calls as they are made."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

MICROS = 1_000_000


def decide(taken: deque, t: int, window: int, most: int) -> tuple[int, bool, float]:
    """(requests admitted in the window that ends at t, whether this one is, seconds until one would be); ``taken`` has the times of admitted ones and takes this one's."""
    while taken and taken[0] <= t - window:
        taken.popleft()
    n = len(taken)
    if n < most:
        taken.append(t)
        return n, True, 0.0
    return n, False, max(0, taken[0] + window - t) / MICROS


def admitted(requests: DataFrame, key: str, request_id: str, ts: str = "ts", seconds: int = 60, most: int = 10) -> DataFrame:
    """(key, request_id, ts, in_window, allowed, wait_seconds) of every request of a log, decided in the order of time, ties by id.

    A key's requests pass through one task in order, which holds its ``most`` last admitted times, whatever the number of requests. Rows without time are left out; a null key is a key."""
    ship(requests.sparkSession)
    rows = requests.where(F.col(ts).isNotNull()).select(key, request_id, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    order = rows.repartition(key).sortWithinPartitions(key, "_t", request_id)
    kind = dict(rows.dtypes)
    window = seconds * MICROS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = object(), deque()
        for f in frames:
            out = []
            for k, t in zip(f[key].astype(object).where(f[key].notna(), None), f["_t"], strict=True):
                if k != now:
                    now, taken = k, deque()
                out.append(decide(taken, int(t), window, most))
            yield f[[key, request_id, ts]].assign(in_window=[n for n, _, _ in out], allowed=[a for _, a, _ in out], wait_seconds=[w for _, _, w in out])

    return order.mapInPandas(run, f"{key} {kind[key]}, {request_id} {kind[request_id]}, {ts} {kind[ts]}, in_window bigint, allowed boolean, wait_seconds double")


class Admission(StatefulProcessor):
    """State of a key: the times of admitted requests, at most ``most``, and requests whose time the watermark has not reached; a timer at each request's time decides all that are due, in order."""

    def __init__(self, key: str, kind: str, id_kind: str, seconds: int, most: int):
        self.key, self.kind, self.id_kind, self.window, self.most = key, kind, id_kind, seconds * MICROS, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "t bigint")
        self.waiting = handle.getListState("waiting", f"t bigint, request_id {self.id_kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            new = [(int(t), i) for t, i in zip(f["micros"], f["request_id"].tolist(), strict=True)]
            if new:
                self.waiting.appendList(new)
                for t in {-(-t // 1000) for t, _ in new}:
                    self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= upto]
        if not due:
            return iter(())
        taken = deque(x[0] for x in self.taken.get()) if self.taken.exists() else deque()
        out = [(key[0], i, t, *decide(taken, t, self.window, self.most)) for t, i in due]
        self._put(self.taken, [(t,) for t in taken])
        self._put(self.waiting, waiting[len(due) :])
        return iter((pd.DataFrame(out, columns=[self.key, "request_id", "micros", "in_window", "allowed", "wait_seconds"]),))

    @staticmethod
    def _put(state, rows: list) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, key: str, request_id: str, ts: str = "ts", seconds: int = 60, most: int = 10, late: str = "1 minute") -> DataFrame:
    """The same of a stream, by event time: a request is decided when the watermark has passed it, so requests that come out of order within ``late`` are decided in their order; later ones are left out by Spark.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    ship(requests.sparkSession)
    kind = dict(requests.dtypes)
    at = F.col(ts).cast("timestamp").alias("at_time")
    rows = requests.select(key, F.col(request_id).alias("request_id"), at).withWatermark("at_time", late).withColumn("micros", F.unix_micros("at_time"))
    schema = f"{key} {kind[key]}, request_id {kind[request_id]}, micros bigint, in_window bigint, allowed boolean, wait_seconds double"
    out = rows.groupBy(key).transformWithStateInPandas(Admission(key, kind[key], kind[request_id], seconds, most), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(key, F.col("request_id").alias(request_id), F.timestamp_micros("micros").alias(ts), "in_window", "allowed", "wait_seconds")


class Limiter:
    """Slots for calls made here: ``wait`` returns when one is free and takes it."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window, self.clock, self.sleep, self.taken = most, int(seconds * MICROS), clock, sleep, deque()

    def wait(self) -> float:
        """Seconds waited."""
        waited = 0.0
        while True:
            _, ok, seconds = decide(self.taken, int(self.clock() * MICROS), self.window, self.most)
            if ok:
                return waited
            self.sleep(max(seconds, 1e-3))
            waited += seconds
