"""Uploads over time: a queue of snapshots with acknowledgements, retries and timers, and pairs of events from two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BATCH, PENDING = 25, 200
#: Seconds to wait after the first failure, doubled with each further one, and at most.
FIRST_WAIT, LONGEST_WAIT = 2, 300
OUT = "user_id long, at timestamp, attempt int, place int, id string, text_hash string"


def wait_after(failures: int) -> int:
    """Seconds to wait after so many failures in a row."""
    return min(LONGEST_WAIT, FIRST_WAIT * 2 ** min(failures - 1, 30))


class UploadQueue(StatefulProcessor):
    """The queue of one user. Input kinds: `add` (a snapshot: id, text_hash), `done` and `failed` (the batch that is out).

    Pending snapshots are a list of at most PENDING, the newest last; equal texts are one, at the later one's place. An id is taken once, as long as it
    is remembered (state with a time to live). A batch of the oldest BATCH goes out when none is out; after a failure the next attempt
    waits for a timer in event time.
    """

    def __init__(self, remember_ms: int = 30 * 86_400_000):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "id string, text_hash string")
        self.out = handle.getListState("out", "id string, text_hash string")
        self.waits = handle.getValueState("waits", "failures int, until long")
        self.seen = handle.getMapState("seen", "id string", "at long")

    def _waits(self) -> tuple[int, int]:
        return self.waits.get() if self.waits.exists() else (0, 0)

    def _send(self, key, rows: list[tuple[str, str]], now: int) -> list[tuple]:
        batch = rows[:BATCH]
        self.out.put(batch)
        return [(key[0], pd.Timestamp(now, unit="ms"), self._waits()[0] + 1, k + 1, *r) for k, r in enumerate(batch)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "kind", "id"], kind="stable", na_position="first")
        pending = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        out = [tuple(r) for r in self.out.get()] if self.out.exists() else []
        sent = []
        for ts, kind, id_, text_hash in events[["ts", "kind", "id", "text_hash"]].itertuples(index=False):
            now = int(pd.Timestamp(ts).value // 1_000_000)
            if kind == "add":
                if id_ is None or text_hash is None or self.seen.containsKey((id_,)) and self.seen.getValue((id_,))[0] > now - self.remember_ms:
                    continue
                self.seen.updateValue((id_,), (now,))
                pending = [r for r in pending if r[1] != text_hash] + [(id_, text_hash)]
                pending = pending[-PENDING:]
            elif kind == "done" and out:
                pending, out = [r for r in pending if r not in out], []
                self.waits.clear()
            elif kind == "failed" and out:
                failures = self._waits()[0] + 1
                until = now + 1000 * wait_after(failures)
                self.waits.update((failures, until))
                self.handle.registerTimer(until)
                out = []
            if pending and not out and now >= self._waits()[1]:
                sent += self._send(key, pending, now)
                out = pending[:BATCH]
        self._keep(pending, out)
        yield self._frame(sent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        pending = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        due = bool(pending) and not self.out.exists() and at >= self._waits()[1]
        yield self._frame(self._send(key, pending, at) if due else [])

    def _keep(self, pending: list, out: list) -> None:
        for state, rows in ((self.pending, pending), (self.out, out)):
            if rows:
                state.put(rows)
            else:
                state.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def upload_attempts(events: DataFrame, lateness: str = "10 seconds", remember_ms: int = 30 * 86_400_000) -> DataFrame:
    """events(user_id, ts, kind, id, text_hash) as a stream -> rows of OUT: each snapshot of each batch that goes out, with the attempt's number.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). A null id or text_hash is no snapshot; rows of other
    kinds only let time pass."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "id", "text_hash").withWatermark("ts", lateness)
    return e.groupBy("user_id").transformWithStateInPandas(UploadQueue(remember_ms), OUT, "Append", "EventTime")


def paired_stream(left: DataFrame, right: DataFrame, key: str, at: str, value: str, within: float = 4.0, lateness: str = "10 seconds") -> DataFrame:
    """Streams left(key, at, ...) and right(key, at, value) -> each row of left with the value of the last row of right at most `within` seconds before
    it, null if there is none.

    An outer join of intervals: both sides have watermarks, so state goes once no partner can come, and rows later than `lateness` are dropped.
    A row of left comes out when the watermark has passed it; equal rows of left are one. Of right rows at one time the greatest value counts.
    """
    l = left.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)  # noqa: E741
    r = right.select(F.col(key).alias("_k"), F.col(at).cast("timestamp").alias("_t"), F.col(value).alias("_v")).withWatermark("_t", lateness)
    near = (F.col(key) == F.col("_k")) & (F.col("_t") <= F.col(at)) & (F.col("_t") >= F.col(at) - F.make_dt_interval(secs=F.lit(within)))
    return l.join(r, near, "leftOuter").groupBy(*left.columns).agg(F.max(F.struct("_t", "_v")).alias("_p")).select(*left.columns, F.col("_p._v").alias(value))
