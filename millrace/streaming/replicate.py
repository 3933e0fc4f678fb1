"""Change streams into replica tables: snapshot first, then micro-batches, replay-safe."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.embed import check_dim
from millrace.operators import codec
from millrace.operators.documents import deleted, to_render, vector_rows
from millrace.operators.fold import fold, key_columns, typed
from millrace.operators.ingest import assembled, carry_key_changes, snapshot_events, values_of
from millrace.operators.merge import empty_replica, evolve, merge, upsert
from millrace.sources.registry import Registry, Table
from millrace.sources.wal import Slot, SlotState
from millrace.streaming.keyword_index import KeywordIndex
from millrace.streaming.store import Conflict, Store
from millrace.streaming.vector_index import VectorIndex

#: How often a batch starts over when another writer has changed one of its tables.
ATTEMPTS = 5


@dataclass
class Flush:
    """What one table's merge took."""

    table: str
    batch: int
    seconds: float
    at: float


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change rows and rejected messages of the change log."""
    return codec.decoded(messages), codec.rejected(messages)


def from_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change rows and rejected rows of raw replication messages, or of rows that ``transactions.committed`` has put together."""
    rows = assembled(raw)
    return rows.where("error is null").drop("error"), rows.where("error is not null")


class Replicator:
    """Folds and merges batches of changes into the store's replicas."""

    def __init__(
        self, store: Store, registry: Registry, query: str, clock: Callable[[], float] = time.time, on_flush: Callable[[Flush], None] | None = None,
        on_reject: Callable[[DataFrame], None] | None = None, decode: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = from_messages,
    ):
        self.store, self.registry, self.query, self.clock = store, registry, query, clock
        self.on_flush, self.on_reject, self.decode = on_flush, on_reject, decode

    def merged(self, table: Table, changes: DataFrame, base: dict) -> tuple[DataFrame, list[str], list[int] | None]:
        """The touched buckets of a table after its changes; rows that moved to another key bring along what was not resent."""
        keys, rest = list(table.keys), table.columns
        touched = self.store.touched(key_columns(changes.select("pk"), table.keys), keys, table.name, base)
        target = self.store.read(table.name, touched, base) if self.store.exists(table.name, base) else empty_replica(self.store.spark, table.keys, rest)
        target = evolve(target, rest)
        if "prev_pk" in changes.columns:
            changes = carry_key_changes(changes, values_of(target, table.name, keys, list(rest)))
        folded = typed(key_columns(fold(changes, list(rest)), table.keys), rest)
        now = F.timestamp_micros(F.lit(int(self.clock() * 1e6)))
        return merge(target, folded, keys, sorted(rest), now), keys, touched

    def _once(self, changes: DataFrame, held: list[str], query: str, batch: int | None) -> bool:
        base = self.store.manifest()
        if batch is not None and self.store.committed(query, base) >= batch:
            return False
        out, began = {}, {}
        for name in held:
            began[name] = time.monotonic()
            out[name] = self.merged(self.registry.tables[name], changes.where(F.col("table") == name), base)
        done = bool(self.store.commit(out, query, batch, self.clock(), base))
        for name, start in began.items():
            if self.on_flush:
                self.on_flush(Flush(name, -1 if batch is None else batch, time.monotonic() - start, self.clock()))
        return done

    def apply(self, changes: DataFrame, batch: int | None = None, query: str | None = None) -> bool:
        """Merge a batch of change rows into all tables and commit once; False if it was committed before."""
        query = query or self.query
        if batch is not None and self.store.committed(query) >= batch:
            return False
        changes = changes.persist()
        try:
            held = sorted(r[0] for r in changes.select("table").distinct().collect() if r[0] in self.registry.tables)
            for attempt in range(ATTEMPTS):
                try:
                    return self._once(changes, held, query, batch)
                except Conflict:
                    if attempt + 1 == ATTEMPTS:
                        raise
        finally:
            changes.unpersist()
        raise AssertionError("unreachable")

    def batch(self, messages: DataFrame, batch: int) -> None:
        """A ``foreachBatch`` sink: Spark records the batch as done only after this has committed."""
        if self.store.committed(self.query) >= batch:
            # a replay; it is read all the same, so that operators with state move on
            messages.write.format("noop").mode("overwrite").save()
            return
        changes, rejected = self.decode(messages)
        if self.on_reject:
            self.on_reject(rejected)
        self.apply(changes, batch)

    def backfill(self, tables: Mapping[str, DataFrame], start) -> None:
        """Snapshot rows before any stream starts.

        A table's backfill is a batch of its own: a crash leaves nothing of it and a repeat is skipped, so it neither undoes
        what streams have changed since nor brings back what they have deleted.
        """
        for name, rows in sorted(tables.items()):
            t = self.registry.tables[name]
            events = snapshot_events(rows.select(*t.ordered), name, list(t.keys), start)
            self.apply(events.withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0).cast("long")), 0, f"backfill of {name}")

    def backfilled(self, name: str) -> bool:
        return self.store.committed(f"backfill of {name}") >= 0

    def resume(self, slot: Slot, tables: Mapping[str, DataFrame], start) -> SlotState:
        """Create a slot or resume it: a fresh one first gets the snapshot, before any stream starts.

        Only when all tables are in does the slot count as having its snapshot; a run that was cut short goes on with the tables that are left.
        """
        state = slot.ensure()
        if state.fresh:
            self.backfill({n: t for n, t in tables.items() if not self.backfilled(n)}, start)
            slot.snapshot_done()
        return state

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None, gate: Gate | None = None):
        """Run over a stream of messages; without ``every``, until all that is there has been read, in as many batches as that takes."""
        def sink(df: DataFrame, n: int) -> None:
            if gate:
                gate.wait()
            self.batch(df, n)

        writer = stream.writeStream.queryName(self.query).option("checkpointLocation", checkpoint).foreachBatch(sink)
        if every:
            return writer.trigger(processingTime=every).start()
        return drained(writer.trigger(processingTime="0 seconds").start())


def drained(query: StreamingQuery) -> StreamingQuery:
    """Let a query run until its sources have nothing more, then stop it; what it fails with is told by ``awaitTermination``.

    A one-shot trigger asks some sources for their end only once, so that one with bounded batches would stop after the first.
    """
    def watch() -> None:
        try:
            query.processAllAvailable()
        except Exception:  # noqa: BLE001  the query keeps it
            return
        query.stop()

    threading.Thread(target=watch, daemon=True).start()
    return query


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of documents with their key in one column."""
    return rows.withColumn("key", F.concat_ws(":", "table", "pk_key"))


class DocumentWriter:
    """The second consumer of the stream: a document and an embedding a row."""

    VECTORS = "search.documents"

    def __init__(self, store: Store, registry: Registry, query: str, embedded: Mapping[str, list[str]], render: Callable[[DataFrame], DataFrame], embed, clock: Callable[[], float] = time.time, embedder=None, words: KeywordIndex | None = None, vectors: VectorIndex | None = None):
        """``embedder``, if given, is asked for its dimension, which must be that of the stored vectors.

        ``words`` and ``vectors`` are indexes over the documents, by table and key; once built (``index``), each batch keeps them up in its own commit.
        """
        self.store, self.registry, self.query = store, registry, query
        self.embedded, self.render, self.embed, self.clock, self.embedder = embedded, render, embed, clock, embedder
        self.words, self.vectors = words, vectors
        if embedder is not None and (dim := store.meta(self.VECTORS).get("dim")):
            check_dim(dim, embedder)

    def _once(self, folded: DataFrame, batch: int) -> None:
        base = self.store.manifest()
        now = F.timestamp_micros(F.lit(int(self.clock() * 1e6)))
        rows = vector_rows(self.render(to_render(folded, self.embedded)), self.embed(F.col("text")), now)
        keys = ["table", "pk_key"]
        touched = self.store.touched(folded, keys, self.VECTORS, base)
        target = self.store.read(self.VECTORS, touched, base) if self.store.exists(self.VECTORS, base) else self.store.spark.createDataFrame([], rows.schema)
        gone = deleted(folded, self.embedded)
        notes = {self.VECTORS: {"dim": self.embedder.dim}} if self.embedder is not None else {}
        tables = {self.VECTORS: (upsert(target, rows, gone, keys), keys, touched)}
        if self.words is not None and self.words.exists(base):
            more, said = self.words.changes(keyed(rows), keyed(gone), base)
            tables, notes = tables | more, notes | said
        if self.vectors is not None and self.vectors.exists(base):
            tables |= self.vectors.changes(keyed(rows), keyed(gone), base)
        self.store.commit(tables, self.query, batch, self.clock(), base, notes)

    def index(self, cells: int | None = None) -> None:
        """Build the indexes over the documents that there are. Not beside a running stream."""
        docs = keyed(self.store.read(self.VECTORS))
        if self.words is not None:
            self.words.build(docs)
        if self.vectors is not None:
            self.vectors.build(docs, cells)

    def batch(self, messages: DataFrame, batch: int) -> None:
        if self.store.committed(self.query) >= batch:
            return
        changes = codec.decoded(messages).where(F.col("table").isin(*self.embedded))
        columns = sorted({c for t in self.embedded for c in self.registry.tables[t].columns})
        folded = fold(changes, columns).persist()
        try:
            for attempt in range(ATTEMPTS):
                try:
                    return self._once(folded, batch)
                except Conflict:
                    if attempt + 1 == ATTEMPTS:
                        raise
        finally:
            folded.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        writer = stream.writeStream.queryName(self.query).option("checkpointLocation", checkpoint).foreachBatch(self.batch)
        return writer.trigger(processingTime=every).start() if every else drained(writer.trigger(processingTime="0 seconds").start())


class SnapshotLoop:
    """Refreshes the copy of a table that batch answers come from: soon after the start, then in turn."""

    def __init__(self, store: Store, table: str, copy: str | None = None, first: float = 20.0, every: float = 300.0, clock: Callable[[], float] = time.time):
        self.store, self.table, self.copy = store, table, copy or table + ".snapshot"
        self.first, self.every, self.clock = first, every, clock
        self.due = clock() + first

    def tick(self) -> bool:
        """Refresh if it is time; a table that isn't there yet is tried again next time."""
        if self.clock() < self.due:
            return False
        self.due = self.clock() + self.every
        try:
            self.store.snapshot(self.table, self.copy, self.clock())
        except LookupError:
            return False
        return True

    def run(self, stopped: Callable[[], bool], sleep: Callable[[float], None] = time.sleep) -> None:
        while not stopped():
            self.tick()
            sleep(max(0.0, min(1.0, self.due - self.clock())))


class Gate:
    """Pause and resume; a timed pause lifts itself and any explicit change cancels its timer."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.until, self.shut = clock, None, False

    def pause(self, seconds: float | None = None) -> None:
        self.shut, self.until = True, None if seconds is None else self.clock() + seconds

    def resume(self) -> None:
        self.shut, self.until = False, None

    @property
    def paused(self) -> bool:
        if self.shut and self.until is not None and self.clock() >= self.until:
            self.resume()
        return self.shut

    def wait(self, every: float = 0.2) -> None:
        while self.paused:
            time.sleep(every)

    def phase(self, streaming: bool, backfilling: bool = False) -> str:
        return "paused" if self.paused else "backfill" if backfilling else "streaming" if streaming else "running"


class Hold:
    """Marker files that hold a load back; they count for ``ttl`` seconds and nest."""

    def __init__(self, path: str, ttl: float = 60.0, clock: Callable[[], float] = time.time):
        self.path, self.ttl, self.clock, self.depth = path, ttl, clock, 0

    def __enter__(self) -> Hold:
        self.depth += 1
        with open(self.path, "w", encoding="utf-8") as f:
            f.write(str(self.clock()))
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        self.depth = max(0, self.depth - 1)
        if not self.depth and os.path.exists(self.path):
            os.remove(self.path)

    def active(self) -> bool:
        """Whether a marker counts; an old one is removed."""
        try:
            with open(self.path, encoding="utf-8") as f:
                fresh = self.clock() - float(f.read()) < self.ttl
        except (OSError, ValueError):
            return False
        if not fresh:
            os.remove(self.path)
        return fresh
