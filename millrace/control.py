"""The control facade: paging, lookups, id scopes, and the service's answers as dictionaries and frames."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Mapping
from contextlib import nullcontext
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import english, place_note, row_json
from millrace.operators import latency, retrieve, usage, verify
from millrace.operators.documents import PLACE_SUFFIX, PLACES, ranger_log
from millrace.operators.merge import reset_or_insert
from millrace.operators.nearest import nearest
from millrace.sources import log
from millrace.sources.errors import read_errors
from millrace.sources.registry import Registry, Settings
from millrace.streaming.progress import offsets
from millrace.streaming.replicate import ATTEMPTS, Flush, Gate, Hold
from millrace.streaming.store import Conflict, Store

LONGEST_VERIFY = 45.0
PAGE, LARGEST_PAGE = 10, 100
#: Ids that a demonstration may create, and from which on load traffic may only update.
DEMO_IDS, TRAFFIC_FROM = (9000, 9099), 3_000_000_000


def scope_of(i: Column) -> Column:
    """demo, traffic or readonly."""
    return F.when(i.between(*DEMO_IDS), "demo").when(i >= TRAFFIC_FROM, "traffic").otherwise("readonly")


def valid_place(place: str) -> bool:
    return place in PLACES


def key_of(pk: Mapping[str, object]) -> int:
    """The only value of a key, which must be a whole number."""
    if len(pk) != 1:
        raise ValueError("pk must have one column")
    (v,) = pk.values()
    if isinstance(v, bool):
        raise ValueError("pk must be a whole number")
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    if isinstance(v, str) and re.fullmatch(r"[+-]?[0-9]+", v):
        v = int(v)
    if not isinstance(v, int):
        raise ValueError("pk must be a whole number")
    return v


def page_bounds(limit: str | None, offset: str | None) -> tuple[int, int]:
    """Bounds of a page; values that make no sense are ignored."""
    n = int(limit) if limit and limit.isdigit() and 1 <= int(limit) <= LARGEST_PAGE else PAGE
    return n, int(offset) if offset and offset.isdigit() else 0


def page(df: DataFrame, keys: list[str], recency: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Rows of one page: newest first where there is a recency, else by key."""
    order = [F.desc_nulls_last(recency), *[F.desc(k) for k in keys]] if recency else [F.asc(k) for k in keys]
    return df.orderBy(*order).offset(offset).limit(limit)


def lookup(source: DataFrame, replica: DataFrame, key: str, value) -> DataFrame:
    """A row's JSON on both sides; null where it is missing."""
    def row(df: DataFrame, side: str) -> DataFrame:
        return df.where(F.col(key) == F.lit(value)).agg(F.first(row_json(df.columns)).alias(side))

    return row(source, "source").crossJoin(row(replica, "replica"))


class Publisher(Protocol):
    """Takes change rows and returns when they are safe."""

    def publish(self, changes: DataFrame) -> None: ...


class Asker(Protocol):
    """Answers questions over the documents."""

    def ask(self, question: str, mode: str) -> dict: ...


class LogPublisher:
    """Appends to the change log's files."""

    def __init__(self, path: str, partitions: int = 4):
        self.path, self.partitions = path, partitions

    def publish(self, changes: DataFrame) -> None:
        log.publish(changes, self.path, self.partitions)


OBSERVATIONS, ANIMALS, HOLES = "public.observations", "public.animals", "public.watering_holes"
OBSERVATION_TYPES = {"observation_id": "bigint", "animal_id": "bigint", "watering_hole_id": "bigint", "observed_at": "timestamp with time zone", "notes": "text"}


def first_by(df: DataFrame, key: str) -> DataFrame:
    """The row with the smallest key."""
    return df.orderBy(key).limit(1)


def default_row(animals: DataFrame, holes: DataFrame, observation_id: Column, place: Column, at: Column) -> DataFrame:
    """A demonstration row in its default shape: the first animal at the first watering hole."""
    a = first_by(animals.select("animal_id", F.col("name").alias("animal"), "species"), "animal_id")
    h = first_by(holes.select("watering_hole_id", F.col("name").alias("hole")), "watering_hole_id")
    note = ranger_log(F.col("animal"), F.col("species"), F.col("hole"), place)
    return a.crossJoin(h).select(observation_id.alias("observation_id"), F.col("animal_id").cast("long").alias("animal_id"), F.col("watering_hole_id").cast("long").alias("watering_hole_id"), at.alias("observed_at"), note.alias("notes"))


def moved_rows(rows: DataFrame, animals: DataFrame, holes: DataFrame, place: Column) -> DataFrame:
    """Observations with another place in their notes; notes without one are written anew from the names of the row's own animal and watering hole."""
    a = animals.select("animal_id", F.col("name").alias("__animal"), F.col("species").alias("__species"))
    h = holes.select("watering_hole_id", F.col("name").alias("__hole"))
    anew = F.when(F.col("__animal").isNotNull() & F.col("__hole").isNotNull(), ranger_log(F.col("__animal"), F.col("__species"), F.col("__hole"), place))
    out = rows.join(a, "animal_id", "left").join(h, "watering_hole_id", "left")
    return out.withColumn("notes", place_note(F.coalesce("notes", F.lit("")), place, PLACE_SUFFIX, anew)).select(*rows.columns)


class Demo:
    """Writes of visitors: one observation of the source is created or reset, moved, or deleted, and the change published.

    The source's tables are in a store, whose manifest numbers are the log's LSNs; its clock is read just before the commit.
    """

    def __init__(self, source: Store, publisher: Publisher, clock: Callable[[], float] = time.time):
        self.source, self.publisher, self.clock = source, publisher, clock

    def poke(self, op: str, pk: Mapping[str, object], place: str | None = None, table: str = OBSERVATIONS, **given) -> dict:
        if table != OBSERVATIONS:
            raise ValueError(f"{table} takes no changes here")
        if given:
            raise ValueError(f"unknown fields: {', '.join(sorted(given))}")
        if set(pk) != {"observation_id"}:
            raise ValueError("a change names one row by its observation_id")
        if op not in ("c", "u", "d"):
            raise ValueError(f"{op!r} is none of c, u, d")
        i = key_of(pk)
        scope = "demo" if DEMO_IDS[0] <= i <= DEMO_IDS[1] else "traffic" if i >= TRAFFIC_FROM else "readonly"
        if scope == "readonly":
            raise ValueError(f"id {i} lies outside the ids that visitors may change")
        if scope == "traffic" and op != "u":
            raise ValueError(f"id {i} belongs to the load, which allows updates alone")
        place = PLACES[0] if op == "c" and not place else place
        if op != "d" and not valid_place(place or ""):
            raise ValueError(f"{place!r} is no known place")
        for attempt in range(ATTEMPTS):
            try:
                existed, at, lsn = self._written(op, i, place)
                break
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
        # a reset of a row is an update, as in any log of the source
        sent = "d" if op == "d" else "u" if existed else "c"
        if op != "d" or existed:
            self.publisher.publish(self._change(sent, i, lsn, at))
        return {"op": op, "table": table, "pk": i, "commit_ts": datetime.fromtimestamp(at, UTC)} | ({} if op == "d" else {"place": place})

    def _written(self, op: str, i: int, place: str | None) -> tuple[bool, float, int]:
        """Change the row in its bucket: whether there was one, the commit's time and its LSN."""
        spark, base = self.source.spark, self.source.manifest()
        touched = self.source.touched(spark.createDataFrame([(i,)], "observation_id long"), ["observation_id"], OBSERVATIONS, base)
        held = self.source.read(OBSERVATIONS, touched, base)
        animals, holes = (self.source.read(t, state=base) for t in (ANIMALS, HOLES))
        own, where = held.where(F.col("observation_id") == i), F.lit(place)
        existed = not own.isEmpty()
        if op == "c":
            now = F.timestamp_micros(F.lit(int(self.clock() * 1e6)))
            fresh = default_row(animals, holes, F.lit(i).cast("long"), where, now)
            # a row that exists is put back to that shape, but for its time
            after = reset_or_insert(held, fresh.select(*held.columns), ["observation_id"], ["observed_at"])
        elif op == "u":
            if not existed:
                raise LookupError(f"observation {i} is not there")
            after = held.where(F.col("observation_id") != i).unionByName(moved_rows(own, animals, holes, where))
        else:
            after = held.where(F.col("observation_id") != i)
        at = self.clock()
        lsn = self.source.commit({OBSERVATIONS: (after, ["observation_id"], touched)}, now=at, base=base)
        return existed, at, lsn

    def _change(self, op: str, i: int, lsn: int, at: float) -> DataFrame:
        spark = self.source.spark
        rest = [c for c in OBSERVATION_TYPES if c != "observation_id"]
        after = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if op != "d" else F.lit(None).cast("map<string,string>")
        rows = spark.range(1).select(F.lit(i).alias("observation_id")) if op == "d" else self.source.read(OBSERVATIONS, state=self.source.at(lsn)).where(F.col("observation_id") == i)
        types = F.create_map(*[F.lit(x) for kv in OBSERVATION_TYPES.items() for x in kv])
        return rows.select(
            F.lit(op).alias("op"), F.lit(OBSERVATIONS).alias("table"), F.lit(lsn).cast("long").alias("lsn"), F.timestamp_micros(F.lit(int(at * 1e6))).alias("commit_ts"),
            F.create_map(F.lit("observation_id"), F.col("observation_id").cast("string")).alias("pk"), after.alias("after"), F.array().cast("array<string>").alias("unchanged"),
            types.alias("types"), F.lit(0).alias("partition"), F.lit(lsn).cast("long").alias("offset"),
        )


@dataclass(frozen=True)
class View:
    """A table that may be read page by page: its key, the column that says what changed last, the columns shown, and whether the source lacks it."""

    key: str
    recency: str
    columns: tuple[str, ...] = ()
    replica_only: bool = False


def counted(source: DataFrame | None, replica: DataFrame | None) -> dict[str, int | None]:
    """Rows on both sides; null where a side lacks the table."""
    return {"source": None if source is None else source.count(), "replica": None if replica is None else replica.count()}


@dataclass(frozen=True)
class Access:
    """Who may ask what: one pipeline, a bearer token for control, allowed origins."""

    pipeline: str = "default"
    token: str | None = None
    origins: tuple[str, ...] = ()

    def known(self, pipeline: str) -> bool:
        return pipeline == self.pipeline

    def allowed(self, header: str | None) -> bool:
        import hmac

        return not self.token or hmac.compare_digest(header or "", f"Bearer {self.token}")

    def origin(self, origin: str | None) -> str | None:
        return origin if origin in self.origins or "*" in self.origins else None


class Service:
    """What a control API answers, without HTTP."""

    def __init__(self, store: Store, registry: Registry, error_log: str, access: Access | None = None, gate: Gate | None = None, clock: Callable[[], float] = time.time):
        self.store, self.registry, self.error_log, self.clock = store, registry, error_log, clock
        self.access, self.gate = access or Access(), gate or Gate()
        self.flushes: list[Flush] = []

    @classmethod
    def configured(cls, spark, settings: Settings, registry: Registry) -> Service:
        """A service over the settings' store, error log, token and origins."""
        access = Access(token=settings.token or None, origins=tuple(o.strip() for o in settings.origins.split(",") if o.strip()))
        return cls(Store(spark, settings.store), registry, settings.error_log, access)

    def record(self, flush: Flush) -> None:
        self.flushes = [*self.flushes, flush][-usage.RING :]

    def health(self) -> dict:
        return {"status": "ok"}

    def summary(self) -> dict:
        return {"id": self.access.pipeline, "tables": self.registry.published(), "phase": self.gate.phase(streaming=True)}

    def detail(self) -> dict:
        return self.summary() | {"replicas": [t for t in self.registry.replicas() if self.store.exists(t)], "merge": self.merge_times()}

    def merge_times(self) -> dict:
        spark = self.store.spark
        rows = [(f.at, f.seconds * 1000) for f in self.flushes]
        return usage.merge_times(spark.createDataFrame(rows, "at double, duration_ms double")).first().asDict()

    def usage(self, start: str | None = None, end: str | None = None) -> dict:
        since, to = usage.parse_window(start, end)
        held = {t: self.store.read(t) for t in self.registry.replicas() if self.store.exists(t)}
        if not held:
            return {"tables": [], "freshness": None}
        return {"tables": [r.asDict() for r in usage.window_stats(held, since, to).collect()], "freshness": usage.freshness(list(held.values())).first().asDict()}

    def errors(self, limit: int = 100) -> list[dict]:
        return [r.asDict() for r in read_errors(self.store.spark, self.error_log, limit).collect()]

    def status(self, action: str, seconds: float | None = None) -> dict:
        """Pause, also for a time, or resume."""
        if action == "pause":
            self.gate.pause(seconds)
        elif action == "resume":
            self.gate.resume()
        else:
            raise ValueError("action must be pause or resume")
        return {"paused": self.gate.paused}

    def verify(self, sources: Mapping[str, DataFrame], timeout: float = 0.0, exact: bool = False, hold: Hold | None = None) -> dict:
        """Compare every source with its replica once, or for up to 45 seconds until they match, with the load held back meanwhile."""
        if not 0 <= timeout <= LONGEST_VERIFY:
            raise ValueError(f"timeout must be {LONGEST_VERIFY} seconds at most")
        last: list[dict] = []

        def once() -> bool:
            tables = {n: (df.select(*self.registry.tables[n].ordered), list(self.registry.tables[n].keys)) for n, df in sources.items()}
            replicas = {n: (self.store.read(n).select(*self.registry.tables[n].ordered), list(self.registry.tables[n].keys)) if self.store.exists(n) else None for n in sources}
            last[:] = [r.asDict() for r in verify.compare(tables, replicas, exact).collect()]
            return all(r["matches"] for r in last)

        with hold if hold is not None and timeout else nullcontext():
            return {"matches": verify.converge(once, timeout), "tables": last}

    def table(self, name: str, views: Mapping[str, View], source: DataFrame | None = None, limit: str | None = None, offset: str | None = None, order: str | None = None) -> dict:
        """A page of a table on both sides, newest first or by key, with both counts."""
        if name not in views:
            raise ValueError("this table can't be read")
        view, (n, at) = views[name], page_bounds(limit, offset)
        replica = self.store.read(name) if self.store.exists(name) else None
        source = None if view.replica_only else source

        def rows(df: DataFrame | None) -> list[dict]:
            if df is None:
                return []
            found = page(df, [view.key], None if order == "pk" else view.recency, n, at)
            return [json.loads(r.j) for r in found.select(row_json(list(view.columns) or df.columns).alias("j")).collect()]

        return {"table": name, "pk": view.key, "recency": view.recency, "replica_only": view.replica_only, "limit": n, "offset": at, "counts": counted(source, replica), "source": rows(source), "replica": rows(replica)}

    def row(self, name: str, pk: str, views: Mapping[str, View], source: DataFrame) -> dict:
        """One row on both sides; null where it is missing."""
        if name not in views or views[name].replica_only:
            raise ValueError("this table can't be read")
        key = key_of({views[name].key: pk})
        replica = self.store.read(name) if self.store.exists(name) else source.limit(0)
        found = lookup(source, replica, views[name].key, key).first()
        return {"table": name, "pk": key, "source": found.source and json.loads(found.source), "replica": found.replica and json.loads(found.replica)}

    def traffic(self, hold: Hold) -> dict:
        """Whether the load is held back."""
        return {"held": hold.active()}

    def lag(self, slot: dict, progress: dict | None) -> dict:
        """Lags of the source's reader and of the writer, by partition."""
        parts = [{"partition": p, "committed": max(0, c or 0), "end": e, "lag": max(0, e - max(0, c or 0))} for p, c, e in offsets(progress)] if progress else []
        return {"slot": slot, "backlog": sum(p["lag"] for p in parts), "partitions": parts}

    def latency(self, table: str, since=None) -> str:
        return latency.report(self.store.read(table), since)

    def ask(self, question: str, mode: str, table: str, embedder, answerer=None, words=None, vectors=None, probe: int | None = None) -> dict:
        """Keyword and vector hits over the live documents or their last copy, and an answer.

        Live questions go to the indexes ``words`` and ``vectors`` where these are given, the latter with ``probe`` cells or exactly.
        """
        question = retrieve.checked_question(question)
        if mode not in ("live", "batch"):
            raise ValueError("mode must be live or batch")
        name = table if mode == "live" else table + ".snapshot"
        if not self.store.exists(name):
            raise LookupError("documents are not ready" if mode == "live" else "no snapshot yet")
        spark = self.store.spark
        docs = self.store.read(name).withColumn("key", F.concat_ws(":", "table", "pk_key"))
        asked = spark.createDataFrame([(0, question)], "question_id long, text string")
        live = mode == "live"
        if words is not None and live:
            said = words.search(asked, terms=retrieve.TERMS)
        else:
            said = retrieve.keyword_top(docs, retrieve.question_terms(asked, retrieve.TERMS, split=english), split=english)
        query = spark.createDataFrame([(0, embedder.embed([question], True)[0])], "question_id long, embedding array<float>")
        near = vectors.search(query, retrieve.TOP, probe) if vectors is not None and live else nearest(docs, query, retrieve.TOP)
        hits = retrieve.contexts(retrieve.hybrid(said, near), docs).join(docs.select("key", "commit_ts"), "key").orderBy("rank").collect()
        found = [r.context for r in hits]
        newest = max((r.commit_ts for r in hits if r.commit_ts), default=None)
        out = {"answer": (answerer or retrieve.Extractive()).answer(question, found), "sources": [r.asDict() for r in hits], "as_of": self.store.as_of(name), "newest": newest}
        # a copy lags behind by its age; live answers are as fresh as their newest row
        return out | {"stale_by": max(0.0, self.clock() - out["as_of"]) if mode == "batch" else None}
