"""Leases that run out by themselves: the item fold as keyed state with timers.

An item keeps what its newest claim or requeue still depends on: that event, how many
claims there have been, and the requests that came behind it. Events may arrive in any
order; each trigger folds the items it touches again. A running item has a timer at the end
of its lease. When the clock of the arrivals passes it, the item goes back to the queue, or
fails once its attempts are used up, without a further event of its own; an event that
arrives later still is folded as if it had been there, and the lease judged anew.

The clock is when events arrive (``seen_at``), not when they happened, so no event is too
late for it; it stands a millisecond behind the last arrival, and a lease is over once the
clock has reached its end. State lives in RocksDB and in the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirefold import constants as K
from quirefold.operators.ledger import TERMINAL
from quirefold.session import materialize
from quirefold.streaming.levels import LevelledTable, newest
from quirefold.streaming.runner import new_folder
from quirefold.streaming.store import each_trigger

ITEM = ("ws", "item_id")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPENER = "attempts bigint, seq bigint, token bigint, owner string, ts bigint, steps bigint"
_REQUEST = "seq bigint, kind string, token bigint, code string, ts bigint"
_FIELDS = ("ws", "item_id", "state", "attempts", "fencing_token", "lease_owner", "lease_ms", "failure_code", "outcome", "step")
_OUT = (
    "ws string, item_id string, state string, attempts bigint, fencing_token bigint, lease_owner string, lease_ms bigint, failure_code string, "
    "outcome string, step bigint"
)


class LeaseFold(StatefulProcessor):
    """Rows of what an item has come to, one per trigger that touches it and one when its lease runs out."""

    def __init__(self, lease_ms: int, max_attempts: int) -> None:
        self.lease_ms, self.max_attempts = lease_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opener = handle.getValueState("opener", _OPENER)
        self.requests = handle.getListState("requests", _REQUEST)

    def _read(self) -> tuple[list, list[tuple]]:
        opener = list(self.opener.get()) if self.opener.exists() else [0, None, None, None, None, 0]
        return opener, [tuple(r) for r in self.requests.get()]

    def _row(self, key: tuple, opener: list, requests: list[tuple], now: int) -> tuple[Row, int | None]:
        """The item as the batch fold and, where its lease is over at ``now``, the sweep have it; and the end of its lease."""
        attempts, seq, token, owner, ts, _ = opener
        opener[5] += 1
        mine = [r for r in requests if token is not None and r[2] == token]
        end = min((r for r in mine if r[1] in TERMINAL), default=None, key=lambda r: r[0])
        state = "queued" if token is None else TERMINAL[end[1]] if end else "running"
        code = end[3] if state == "failed" else "cancelled" if state == "cancelled" else None
        lease = outcome = None
        if state == "running":
            lease = max([ts, *[r[4] for r in mine if r[1] == "heartbeat"]]) + self.lease_ms
            if lease <= now:
                outcome = "requeued" if attempts < self.max_attempts else "exhausted"
                state, code = ("queued", None) if outcome == "requeued" else ("failed", "max_attempts")
        held = state == "running"
        values = (*key, state, attempts, None if outcome == "requeued" else token, owner if held else None, lease if held else None, code, outcome, opener[5])
        return Row(**dict(zip(_FIELDS, values))), lease

    def _settle(self, key: tuple, opener: list, requests: list[tuple], now: int) -> Row:
        row, lease = self._row(key, opener, requests, now)
        self.opener.update(tuple(opener))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lease is not None and row.outcome is None:
            self.handle.registerTimer(lease)
        return row

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        opener, requests = self._read()
        for e in rows:
            opens = e.kind in ("claim", "requeue")
            if opens:
                opener[0] += e.kind == "claim"
                if opener[1] is None or e.seq > opener[1]:
                    opener[1:5] = [e.seq, *((e.token, e.worker) if e.kind == "claim" else (None, None)), e.ts]
            else:
                requests.append((e.seq, e.kind, e.token, e.code, e.ts))
        # requests before the newest claim or requeue can change nothing any more
        requests = [r for r in requests if opener[1] is not None and r[0] > opener[1] or opener[1] is None]
        self.requests.put(requests) if requests else self.requests.clear()
        yield self._settle(key, opener, requests, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        opener, requests = self._read()
        yield self._settle(key, opener, requests, timerValues.getCurrentWatermarkInMs())


def expiring_items(events: DataFrame, lease_s: int = K.LEASE_SECONDS, max_attempts: int = K.MAX_ATTEMPTS, root: str | None = None) -> DataFrame:
    """Every item as of the clock of the last arrival: ``item_state_fold`` with ``lease_sweep`` applied to it.

    ``events`` are those of the ledger with ``seen_at``, when each arrived. ``outcome`` is
    ``requeued`` or ``exhausted`` where a lease ran out, else NULL.
    """
    spark = events.sparkSession
    table = LevelledTable(spark, root or new_folder(spark, "leases"), f"{_OUT}, _version bigint", ITEM, lambda rows: newest(rows, ITEM))
    slim = events.withWatermark("seen_at", "1 millisecond").select(*ITEM, "seq", F.unix_millis("ts").alias("ts"), "kind", "worker", "token", "code", "seen_at")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = slim.groupBy(*ITEM).transformWithState(LeaseFold(lease_s * 1000, max_attempts), _OUT, "Update", "EventTime")

        def settle(batch: DataFrame, number: int) -> None:
            # an item may have a row for its events and one for its timer; the later step counts
            if not table.settled(number):
                table.add(materialize(batch).withColumn("_version", F.col("step")), number)

        each_trigger(rows, table.root, settle, "update")
    finally:
        spark.conf.set(PROVIDER, before)
    return newest(table.rows(), ITEM).select(
        *ITEM, "state", "attempts", "fencing_token", "lease_owner", F.timestamp_millis("lease_ms").alias("lease_expires_at"), "failure_code", "outcome")
