"""A sliding-window limit: at most so many accepted requests of a client in any window.

Whether one is accepted depends on which before it were, so it is state carried in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.transactions import ROCKS

RESULT = "client string, at long, id long, accepted boolean"


def admit(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Which of the ordered times are accepted, given accepted ones before; and those that still count.

    Requests up to the limit are taken as they come; from then on the next one is the first that is a window younger than
    the ``limit``-th last, and what lies between is passed over at once.
    """
    out = np.zeros(len(times), bool)
    at = 0
    while at < len(times) and limit > 0:
        if len(recent) >= limit:
            at = max(at, int(np.searchsorted(times, recent[-limit] + window, "left")))
            if at == len(times):
                break
        out[at] = True
        recent = [*recent[1 - limit :], int(times[at])] if limit > 1 else [int(times[at])]
        at += 1
    return out, [x for x in recent if len(times) == 0 or x > times[-1] - window]


def limited(requests: DataFrame, limit: int, window_us: int = 60_000_000) -> DataFrame:
    """Batch form over client, at (microseconds), id.

    A client's requests are walked in order through Arrow batches of one sorted partition, so a busy
    client is never held as a whole.
    """
    ordered = requests.select("client", "at", "id").repartition("client").sortWithinPartitions("client", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = object(), []
        for df in batches:
            names, times = df["client"].to_numpy(), df["at"].to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(df)]
            accepted = []
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if names[a] != client:
                    client, recent = names[a], []
                ok, recent = admit(times[a:b], recent, limit, window_us)
                accepted.append(ok)
            yield df.assign(accepted=np.concatenate(accepted) if accepted else [])

    return ordered.mapInPandas(run, RESULT)


#: Watermarks start at the epoch and drop what is not later; times count from a day on.
SHIFT = 86_400_000_000


class Limiter(StatefulProcessor):
    """A client's accepted times of the last window, which a timer forgets once no later request can meet them."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        frame = pd.concat(list(rows)).sort_values(["at", "id"])
        accepted, recent = admit(frame["at"].to_numpy(), recent, self.limit, self.window)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if recent:
            self.recent.update((recent,))
            self.handle.registerTimer((recent[-1] + self.window + SHIFT) // 1000 + 1)
        elif self.recent.exists():
            self.recent.clear()
        yield frame[["client", "at", "id"]].assign(accepted=accepted)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, limit: int, window_us: int = 60_000_000, late: str = "60 seconds") -> DataFrame:
    """Stream form: accepted times of the window are a client's state, forgotten when the watermark has passed them by a window.

    Requests of a batch are taken in order of their times; across batches a client's requests should come in order. Those that are later than ``late`` behind the
    latest time seen are dropped. So the state holds the clients of the last window and ``late`` only.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = requests.select("client", "at", "id", F.timestamp_micros(F.col("at") + SHIFT).alias("ts")).withWatermark("ts", late)
    return timed.groupBy("client").transformWithStateInPandas(Limiter(limit, window_us), RESULT, "append", "eventtime")


def client_address(forwarded: str | None, remote: str) -> str:
    """The first forwarded address, else the peer's."""
    first = (forwarded or "").split(",")[0].strip()
    return first or remote.rsplit(":", 1)[0]
