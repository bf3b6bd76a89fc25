"""D3/M4: payouts that follow many payments in, by keyed state.

The state of an account is what can still matter: the payments in of the last ``within`` and the payouts that a late payment can
still come before. It is pruned by the watermark with every row and by a timer when no more rows come, and is dropped when empty.
Rows may arrive in any order as far as the watermark allows: a payout's count is sent when it reaches ``least``, and again
whenever a late payment raises it, so the last count of a payout is the whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from caseloom.streaming.alerts import LATE, run

#: Spark keeps the state of such a step in this store only.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "user_id long, out_id long, ins long"


class Mules(StatefulProcessor):
    def __init__(self, within_ms: int, least: int):
        self.within, self.least = within_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ins array<long>, out_times array<long>, out_ids array<long>, sent array<long>")

    def _load(self):
        if not self.held.exists():
            return [], [], [], []
        return [list(x) for x in self.held.get()]

    def _keep(self, ins, outs, now: int) -> None:
        """Payments in that no payout at or after the watermark can reach go, and payouts before it; the timer is for the last of what stays."""
        ins = [t for t in ins if t >= now - self.within]
        outs = [x for x in outs if x[0] >= now]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if not ins and not outs:
            self.held.clear()
            return
        self.held.update((ins, *([x[k] for x in outs] for k in range(3))))
        self.handle.registerTimer(max([*(t + self.within for t in ins), *(x[0] for x in outs), now]) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ins, *outs = self._load()
        at = new["ms"].tolist()
        ins = sorted(ins + [t for t, x in zip(at, new["is_in"], strict=True) if x])
        outs = [list(x) for x in zip(*outs, strict=True)] + [[t, i, 0] for t, i, x in zip(at, new["event_id"], new["is_in"], strict=True) if not x]
        found = []
        times = pd.Series(ins, dtype="int64")
        for x in outs:
            n = int(times.searchsorted(x[0], "right") - times.searchsorted(x[0] - self.within, "left"))
            if n >= self.least and n > x[2]:
                found.append((key[0], x[1], n))
            x[2] = max(x[2], n)
        self._keep(ins, outs, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(found, columns=["user_id", "out_id", "ins"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ins, *outs = self._load()
        self._keep(ins, [list(x) for x in zip(*outs, strict=True)], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"user_id": [], "out_id": [], "ins": []}).astype("int64")

    def close(self) -> None:
        pass


def mule_counts(events: DataFrame, is_in, is_out, within_hours: int, least: int) -> DataFrame:
    """A stream of (user_id, out_id, ins) from events(event_id, ts, user_id, ...); the highest count of a payout is the last."""
    e = events.withWatermark("ts", LATE).filter(is_in | is_out)
    e = e.select("user_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), is_in.alias("is_in"))
    return e.groupBy("user_id").transformWithStateInPandas(Mules(within_hours * 3_600_000, least), OUT, "Update", "EventTime")


def mules(events: DataFrame, is_in, is_out, within_hours: int, least: int, path: str) -> DataFrame:
    """(user_id, out_id, ins): payouts that follow ``least`` payments in or more of the same user within a time; runs the stream over all that is there.

    The stream goes on from its checkpoint at ``path`` when it is started again; counts it sent before are in its table."""
    spark = events.sparkSession
    before = spark.conf.get(*STORE[:1], None)
    spark.conf.set(*STORE)
    try:
        sent = run(mule_counts(events, is_in, is_out, within_hours, least), path, "update")
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
    return sent.groupBy("user_id", "out_id").agg(F.max("ins").alias("ins"))
