"""Campaign states as a stateful stream: legal moves only, stalled campaigns end by a timer, and a start from checkpoints.

The state of a campaign is its name of state, version and time of the last move. A move that is not legal is refused with
its fault and changes nothing. A campaign that has not moved for `stall` ends as PARTIAL once the watermark is past that.
Rows of a batch are taken in order of (at, n). States given as `initial` (of last checkpoints) come before any move, so
that a campaign that was stopped ends like one that was not.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quarry.operators.events import STATES, legal_moves

MOVES = "search_id string, at timestamp, n long, source string, target string, fault string, version long"
COLUMNS = [c.split()[0] for c in MOVES.split(", ")]


class CampaignMachine(StatefulProcessor):
    def __init__(self, stall: timedelta, timed: bool):
        self.stall_ms, self.timed = int(stall.total_seconds() * 1000), timed
        self.legal = set(legal_moves())
        self.ended = {s for s, forward in STATES.items() if not forward}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, version long, moved long")

    def _timer(self, state: str, moved: int) -> None:
        if not self.timed:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state not in self.ended:
            self.handle.registerTimer(moved + self.stall_ms)

    def _held(self) -> tuple[str, int, int]:
        return tuple(self.now.get()) if self.now.exists() else ("CREATED", 0, 0)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: ARG002, N803
        row = initialState.iloc[0]
        moved = int(pd.Timestamp(row["at"]).timestamp() * 1000)
        self.now.update((row["state"], int(row["version"]), moved))
        self._timer(row["state"], moved)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N803
        state, version, moved = self._held()
        out = []
        for at, n, target in pd.concat(list(rows)).sort_values(["at", "n"])[["at", "n", "target"]].itertuples(index=False):
            fault = "terminal" if state in self.ended else None if (state, target) in self.legal else "illegal"
            if fault is None:
                version, moved = version + 1, int(at.timestamp() * 1000)
            out.append((key[0], at, n, state, target, fault, version))
            state = state if fault else target
        self.now.update((state, version, moved))
        self._timer(state, moved)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N803
        state, version, _ = self._held()
        if state not in self.ended:
            when = expiredTimerInfo.getExpiryTimeInMs()
            self.now.update(("PARTIAL", version + 1, when))
            yield pd.DataFrame([(key[0], pd.Timestamp(when, unit="ms"), None, state, "PARTIAL", None, version + 1)], columns=COLUMNS)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that `moves` needs, for as long as it runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def moves(asked: DataFrame, initial: DataFrame | None = None, stall: timedelta = timedelta(hours=6), late: str = "1 minute") -> DataFrame:
    """asked(search_id, at, n, target) to search_id, at, n, source, target, fault (null: taken), version; a stream or a table.

    `initial` has search_id, state, version, at. A stream needs the RocksDB state store; a table has no timers.
    """
    streaming = asked.isStreaming
    asked.sparkSession.streams.active  # noqa: B018  starts what coordinates state stores, which a table needs too
    rows = asked.select("search_id", "at", "n", "target")
    if streaming:
        rows = rows.withWatermark("at", late)
    given = initial.select("search_id", "state", "version", "at").groupBy("search_id") if initial is not None else None
    machine = CampaignMachine(stall, streaming)
    return rows.groupBy("search_id").transformWithStateInPandas(machine, MOVES, "Append", "eventTime" if streaming else "none", given)


def last_states(taken: DataFrame) -> DataFrame:
    """search_id, state, version, at after the moves that were taken: what a checkpoint holds."""
    return taken.where(F.col("fault").isNull()).groupBy("search_id").agg(F.max_by(F.struct(F.col("target").alias("state"), "version", "at"), "version").alias("x")).select("search_id", "x.*")
