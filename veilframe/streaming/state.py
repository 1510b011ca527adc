"""Custom state: token lifetime and ordered rate-limit decisions, both in event time.

Rows are kept in state by key and hour until the watermark has passed their minute. Then a timer takes the
hours that have begun, one after another; the rows of minutes that are over are put in order and decided, the others
go back. So the way rows fall into batches, and their order within the watermark's delay, do not matter; what a worker
holds at once is one frame of input, or an hour of one key and some ``FRAME`` results, whatever the key's
share of all rows. Calls to the state are by the hour and key, not by the row or minute. A
further timer ends the state of a key that is no longer in use. Rows without a time have no place in the order and get no
decision.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.operators.limits import ALLOWED, DENIED_HOUR, DENIED_MINUTE, HOUR, MINUTE, Limits
from veilframe.streaming.jobs import WATERMARK

PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows wait in buckets of so many microseconds, and results go out in frames of at least so many rows, the last one apart.
BUCKET, FRAME = HOUR, 10_000


class InOrder(StatefulProcessor):
    """Rows (us, row_id, value) of a key in event-time order, by minutes that are over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Of each bucket the number of its parts and the time of its first row.
        self.parts = handle.getMapState("parts", "bucket long", "n long, first long")
        self.rows = handle.getMapState("rows", "bucket long, part long", "rows string")

    def load(self) -> None:
        """Take what was decided so far out of the state."""
        raise NotImplementedError

    def decide(self, key: Any, rows: list[list]) -> pd.DataFrame:
        """Results of rows that follow all rows decided before."""
        raise NotImplementedError

    def save(self) -> None:
        """Put what was decided so far back into the state."""
        raise NotImplementedError

    def ends_at(self) -> int | None:
        """Microsecond from which what was decided has no more effect, None without state."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            value = frame["value"] if "value" in frame else pd.Series([None] * len(frame), dtype=object)
            listed = [
                [int(us), None if pd.isna(row_id) else int(row_id), v if isinstance(v, str) else None]
                for us, row_id, v in zip(frame["us"], frame["row_id"], value)
            ]
            by_bucket: dict[int, list] = {}
            for row in listed:
                by_bucket.setdefault(row[0] // BUCKET, []).append(row)
            for bucket, part in by_bucket.items():
                n, first = self.parts.getValue((bucket,)) if self.parts.containsKey((bucket,)) else (0, part[0][0])
                self.rows.updateValue((bucket, n), (json.dumps(part),))
                self.parts.updateValue((bucket,), (n + 1, min(first, *(row[0] for row in part))))
        self._rearm()
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # Minutes that end at the watermark or before it are over.
        passed = timerValues.getCurrentWatermarkInMs() * 1_000 // MINUTE * MINUTE
        results: list[pd.DataFrame] = []
        self.load()
        for bucket, n in sorted((b, n) for (b,), (n, first) in self.parts.iterator() if first < passed):
            rows: list[list] = []
            for part in range(n):
                rows += json.loads(self.rows.getValue((bucket, part))[0])
                self.rows.removeKey((bucket, part))
            wait = [row for row in rows if row[0] >= passed]
            if wait:
                self.rows.updateValue((bucket, 0), (json.dumps(wait),))
                self.parts.updateValue((bucket,), (1, min(row[0] for row in wait)))
            else:
                self.parts.removeKey((bucket,))
            rows = [row for row in rows if row[0] < passed]
            rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            results.append(self.decide(key, rows))
            if sum(map(len, results)) >= FRAME:
                yield pd.concat(results)
                results = []
        self.save()
        if results:
            yield pd.concat(results)
        end = self.ends_at()
        if end is not None and end < timerValues.getCurrentWatermarkInMs() * 1_000:
            self.forget()
        self._rearm()

    def _rearm(self) -> None:
        """One timer per key: when its next minute is over or, without waiting rows, when its state ends."""
        first = min((first for _, first in self.parts.values()), default=None)
        at = (first // MINUTE + 1) * MINUTE if first is not None else self.ends_at()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at // 1_000 + (0 if first is not None else 1))

    def close(self) -> None:
        pass


class TokenLifetime(InOrder):
    """One token of one session: its original while it is in use."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("token", "original string, last_us long")

    def load(self) -> None:
        self.live = self.state.get() if self.state.exists() else (None, 0)

    def decide(self, key: Any, rows: list[list]) -> pd.DataFrame:
        original, last = self.live
        found = []
        for us, _, value in rows:
            if original is not None and us - last > self.ttl_us:
                original = None
            if value is not None:
                original = value
            if original is not None:
                last = us
            found.append(original)
        self.live = original, last
        return pd.DataFrame({"session_id": key[0], "token": key[1], "row_id": pd.array([r[1] for r in rows], dtype="Int64"), "found": found})

    def save(self) -> None:
        if self.live[0] is not None:
            self.state.update(tuple(self.live))
        elif self.state.exists():
            self.state.clear()

    def ends_at(self) -> int | None:
        return self.state.get()[1] + self.ttl_us if self.state.exists() else None

    def forget(self) -> None:
        self.state.clear()


def token_lookups(accesses: DataFrame, ttl_minutes: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """Original per token access, null once the token was idle longer than its lifetime.

    ``accesses``: session_id, token, original (set when added, null for a lookup), ts, row_id.
    State is keyed by session and token, so one busy session is spread over its tokens.
    """
    timed = accesses.where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    rows = timed.select("session_id", "token", F.col("original").alias("value"), "ts", F.unix_micros("ts").alias("us"), "row_id")
    return rows.groupBy("session_id", "token").transformWithStateInPandas(
        statefulProcessor=TokenLifetime(ttl_minutes * 60_000_000),
        outputStructType="session_id string, token string, row_id long, found string",
        outputMode="Append", timeMode="EventTime",
    )


class RateDecisions(InOrder):
    """Recent accepted requests of one client."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "us long")

    def load(self) -> None:
        self.hour = deque(row[0] for row in self.accepted.get())

    def decide(self, key: Any, rows: list[list]) -> pd.DataFrame:
        hour = self.hour
        minute, decisions = deque(hour), []
        for us, _, _ in rows:
            while hour and hour[0] <= us - HOUR:
                hour.popleft()
            while minute and minute[0] <= us - MINUTE:
                minute.popleft()
            if len(minute) >= self.limits.per_minute:
                decisions.append(DENIED_MINUTE)
            elif len(hour) >= self.limits.per_hour:
                decisions.append(DENIED_HOUR)
            else:
                decisions.append(ALLOWED)
                hour.append(us)
                minute.append(us)
        return pd.DataFrame({"client_id": key[0], "row_id": pd.array([r[1] for r in rows], dtype="Int64"), "decision": decisions})

    def save(self) -> None:
        if self.hour:
            self.accepted.put([(t,) for t in self.hour])
        elif self.accepted.exists():
            self.accepted.clear()

    def ends_at(self) -> int | None:
        accepted = [row[0] for row in self.accepted.get()] if self.accepted.exists() else []
        return max(accepted) + HOUR if accepted else None

    def forget(self) -> None:
        self.accepted.clear()


def rate_limit_stream(requests: DataFrame, limits: Limits = Limits(), watermark: str = WATERMARK) -> DataFrame:
    """Decisions in event-time order; the state per client is one hour of accepts and the rows that wait for the watermark."""
    timed = requests.where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    rows = timed.select("client_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("row_id"))
    return rows.groupBy("client_id").transformWithStateInPandas(
        statefulProcessor=RateDecisions(limits),
        outputStructType="client_id string, row_id long, decision string",
        outputMode="Append", timeMode="EventTime",
    )
