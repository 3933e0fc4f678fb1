"""Transactions put together across micro-batches.

The log is cut into batches after any message, so a transaction's begin, rows and commit may lie in different ones. Rows wait as state of their
transaction until its commit arrives, which stamps them, or until the source begins another one without it, which
drops them. Transactions are independent, so they are dealt over tasks; what waits at any time is the open transaction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.sources.wal import RAW

#: Raw rows with their commit's place; their commit time is the commit's.
COMMITTED = RAW + ", commit_lsn long"
OUT = Row("lsn", "kind", "xid", "commit_ts", "relation_id", "relation", "values", "old", "commit_lsn")
#: Rows held in a task's memory before they go to its state store.
HELD = 2000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Assembly(StatefulProcessor):
    """Keeps a transaction's rows until its commit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", RAW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held: list[tuple] = []
        commit, given_up = None, False
        for r in rows:
            if r.kind == "C":
                commit = (r.lsn, r.commit_ts)
            elif r.kind == "A":
                given_up = True
            elif r.kind in "IUD":
                held.append(tuple(r)[:-1])
                if len(held) >= HELD:
                    self.rows.appendList(held)
                    held = []
        if commit is None and not given_up:
            if held:
                self.rows.appendList(held)
            return
        if commit is not None:
            lsn, at = commit
            for r in chain(self.rows.get() if self.rows.exists() else (), held):
                yield OUT(*r[:3], at, *r[4:], lsn)
        if self.rows.exists():
            self.rows.clear()

    def close(self) -> None:
        pass


def committed(raw: DataFrame) -> DataFrame:
    """The rows of finished transactions of a stream of raw messages (``wal.STREAM``), as raw rows with ``commit_lsn``.

    Rows outside a transaction and messages of no use are dropped.
    """
    raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    told = raw.where("txn is not null and kind in ('I', 'U', 'D', 'C', 'A')")
    return told.groupBy("txn").transformWithState(Assembly(), COMMITTED, "append", "none")
