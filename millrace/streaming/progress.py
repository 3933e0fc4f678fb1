"""What streaming queries report: offsets and lags, flush times, and readings that triage compares."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.operators import usage


def numbers(offset) -> dict[str, int]:
    """The numbers of an offset by their names: ``{"topic": {"0": 5}}`` gives ``topic/0``."""
    found = json.loads(offset) if isinstance(offset, str) else offset
    if found is None:
        return {}
    if not isinstance(found, dict):
        return {"offset": int(found)}
    out: dict[str, int] = {}
    for name, value in found.items():
        if isinstance(value, dict):
            out |= {f"{name}/{k}": n for k, n in numbers(value).items()}
        elif isinstance(value, int) and not isinstance(value, bool):
            out[name] = value
    return out


def _plain(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def offsets(progress) -> list[tuple[str, int | None, int]]:
    """(partition, committed, end) of a progress report's sources: what has been read, and what there is."""
    out = []
    for n, source in enumerate(_plain(progress).get("sources", [])):
        done, last = numbers(source.get("endOffset")), numbers(source.get("latestOffset") or source.get("endOffset"))
        out += [(f"{n}/{p}", done.get(p), end) for p, end in sorted(last.items())]
    return out


def consumer(spark: SparkSession, progress) -> DataFrame:
    """Partitions with what is committed, the end, and the lag."""
    rows = offsets(progress)
    ends = spark.createDataFrame([(p, e) for p, _, e in rows], "partition string, end long")
    return usage.partition_lag(ends, spark.createDataFrame([(p, c) for p, c, _ in rows if c is not None], "partition string, committed long"))


class Progress(StreamingQueryListener):
    """Keeps the last reports of each query, ``RING`` at most."""

    def __init__(self, size: int = usage.RING):
        self.size, self.reports, self.ended = size, {}, {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(event.name, None)

    def onQueryProgress(self, event) -> None:
        self.reports.setdefault(event.progress.name, deque(maxlen=self.size)).append(_plain(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def last(self, name: str) -> dict | None:
        held = self.reports.get(name)
        return held[-1] if held else None


def scrape(query: StreamingQuery | None) -> dict:
    """A query's state and last report; not reachable where it has ended."""
    if query is None or not query.isActive:
        return {"reachable": False, "name": query and query.name, "batch": None, "input_rows": None, "batch_ms": None, "error": str(query.exception()) if query is not None and query.exception() else None}
    last = query.lastProgress
    report = _plain(last) if last else {}
    return {"reachable": True, "name": query.name, "batch": report.get("batchId"), "input_rows": report.get("numInputRows"), "batch_ms": report.get("batchDuration"), "error": None}


@dataclass
class Reading:
    """One look at a pipeline: lag of the source's reader, messages not yet written, median flush, whether the writer answers."""

    at: float
    reader: int
    backlog: int
    merge_ms: float | None
    reachable: bool = True


def reading(slot: dict, progress: dict | None, flush_ms: Iterable[float], reachable: bool = True, clock: Callable[[], float] = time.time) -> Reading:
    """From a slot's information, the writer's last report and the times of its last flushes."""
    held = sorted(flush_ms)
    lag = sum(max(0, end - max(0, done or 0)) for _, done, end in offsets(progress)) if progress else 0
    return Reading(clock(), int(slot.get("lag") or 0), lag, held[int(0.5 * (len(held) - 1) + 0.5)] if held else None, reachable)


def triage(spark: SparkSession, before: Reading, now: Reading) -> str:
    """Where the bottleneck is."""
    b, n = asdict(before), asdict(now)
    row = (b["reader"], n["reader"], b["backlog"], n["backlog"], b["merge_ms"], n["merge_ms"], n["reachable"])
    schema = "reader_before long, reader_now long, backlog_before long, backlog_now long, merge_before_ms double, merge_now_ms double, writer_reachable boolean"
    return usage.triage(spark.createDataFrame([row], schema)).first().bottleneck
