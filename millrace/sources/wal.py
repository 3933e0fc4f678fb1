"""The source's write-ahead log as a stream of raw messages.

A wire gives the log's messages in order; the recorded one here reads files of JSON lines, a live one would speak the
source's replication protocol. A slot remembers how far the log has been taken: it is created once and resumed from then on,
and only a batch that Spark has finished moves it, so what it reports is never ahead of what is done.

A micro-batch ends after any message, by the number of waiting changes or the age of the first. Its offset carries what a reader in the middle of
the log has to know: the transaction that is open and where each relation was last described. So every message names its transaction and every change its
relation, files are read side by side, and ``streaming.transactions`` puts together what batches have cut.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Kinds: B begin, C commit, R relation, I insert, U update, D delete; T truncate, O origin and Y type are of no use here.
RAW = (
    "lsn long, kind string, xid long, commit_ts timestamp, relation_id long, "
    "relation struct<table:string,columns:array<struct<name:string,oid:int,is_key:boolean>>>, "
    "`values` array<struct<kind:string,text:string>>, old array<struct<kind:string,text:string>>"
)
#: What the stream has: raw messages, the place of their transaction's begin, and a message of kind A where a transaction is given up.
STREAM = RAW + ", txn long"
FORMAT = "recorded_wal"


def _files(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Wire(Protocol):
    """The log's messages as dictionaries with the fields of ``RAW``."""

    def messages(self, after: int, upto: int | None = None) -> Iterator[dict]: ...


class RecordedWire:
    """Messages in files of JSON lines, named by their first message's place; each file starts after the one before it ends."""

    def __init__(self, path: str):
        self.path = path

    def files(self) -> list[tuple[int, str]]:
        """(place of the first message, path) in the order of the log."""
        from pyarrow import fs

        files, folder = _files(self.path)
        names = [f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".jsonl") and f.base_name[:-6].isdigit()]
        return sorted((int(n.rsplit("/", 1)[1][:-6]), n) for n in names)

    def within(self, after: int, upto: int | None = None) -> list[tuple[int, str]]:
        """The files that can hold messages after one place and up to another."""
        held = self.files()
        # the last one that starts at or before ``after`` may end after it
        first = max(0, bisect_right([n for n, _ in held], after) - 1)
        return [(n, p) for n, p in held[first:] if upto is None or n <= upto]

    def read(self, path: str) -> Iterator[dict]:
        files, _ = _files(self.path)
        with files.open_input_stream(path) as f:
            for line in f.read().split(b"\n"):
                if line.strip():
                    yield json.loads(line)

    def messages(self, after: int, upto: int | None = None) -> Iterator[dict]:
        for _, path in self.within(after, upto):
            for m in self.read(path):
                if m["lsn"] > after and (upto is None or m["lsn"] <= upto):
                    yield m

    def at(self, lsn: int, relation_id: int) -> dict | None:
        """A relation's description at a place of the log."""
        return next((m for m in self.messages(lsn - 1, lsn) if m["kind"] == "R" and m["relation_id"] == relation_id), None)


@dataclass(frozen=True)
class Position:
    """A place in the log and what is in force there: the open transaction, and where relations were described.

    ``whole`` is, within a transaction, the place before it with its relations: where a reader without state has to resume.
    """

    lsn: int = -1
    begin: int | None = None
    xid: int | None = None
    relations: dict[int, int] = field(default_factory=dict)
    whole: tuple[int, dict[int, int]] | None = None

    def after(self, m: dict) -> Position:
        """The place after a message."""
        if m["kind"] == "B":
            return replace(self, lsn=m["lsn"], begin=m["lsn"], xid=m["xid"], whole=(self.lsn, self.relations))
        if m["kind"] == "C":
            return replace(self, lsn=m["lsn"], begin=None, xid=None, whole=None)
        if m["kind"] == "R":
            return replace(self, lsn=m["lsn"], relations=self.relations | {m["relation_id"]: m["lsn"]})
        return replace(self, lsn=m["lsn"])

    @property
    def resumed(self) -> Position:
        return Position(self.whole[0], relations=self.whole[1]) if self.whole else self

    def offset(self) -> dict:
        # what is carried is text, so that lags count places of the log only
        whole = self.whole and [self.whole[0], sorted(self.whole[1].items())]
        return {"lsn": self.lsn, "carried": json.dumps([self.begin, self.xid, sorted(self.relations.items()), whole])}

    @staticmethod
    def of(offset: dict) -> Position:
        pairs = lambda x: dict(map(tuple, x))
        begin, xid, relations, whole = json.loads(offset["carried"])
        return Position(offset["lsn"], begin, xid, pairs(relations), whole and (whole[0], pairs(whole[1])))


@dataclass
class SlotState:
    """``fresh``: a snapshot must come first, as the slot was just created or its snapshot has not been finished; ``confirmed``: the log up to here is done."""

    name: str
    fresh: bool
    confirmed: int


class Slot:
    """A named place in the log, kept in a file that replaces the one before."""

    def __init__(self, path: str, name: str = "millrace"):
        self.path, self.name = path.rstrip("/"), name

    def _read(self) -> dict | None:
        files, folder = _files(self.path)
        try:
            with files.open_input_stream(f"{folder}/{self.name}.slot") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _write(self, **fields) -> None:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/.{self.name}.new") as f:
            f.write(json.dumps((self._read() or {"confirmed": 0, "snapshot": False}) | fields).encode())
        files.move(f"{folder}/.{self.name}.new", f"{folder}/{self.name}.slot")

    def ensure(self) -> SlotState:
        """Create the slot or resume it."""
        if self._read() is None:
            self._write()
        found = self._read()
        return SlotState(self.name, not found.get("snapshot", False), found["confirmed"])

    def snapshot_done(self) -> None:
        """From now on the slot is resumed without a snapshot."""
        self._write(snapshot=True)

    @property
    def confirmed(self) -> int:
        return (self._read() or {"confirmed": 0})["confirmed"]

    @property
    def position(self) -> Position:
        """Where the log is resumed, with what is in force there."""
        found = self._read() or {}
        return Position.of({"lsn": found["confirmed"], "carried": found["carried"]}) if "carried" in found else Position(found.get("confirmed") or -1)

    def confirm(self, lsn: int, carried: str | None = None) -> None:
        """Report the log as done up to a place; it never goes back."""
        if lsn > self.confirmed:
            self._write(confirmed=lsn, **({"carried": carried} if carried else {}))


def slot_info(wire: Wire, slot: Slot) -> dict:
    """The slot's place, the log's end, and what lies between."""
    found = slot._read()
    if found is None:
        return {"name": slot.name, "active": False, "confirmed": None, "current": None, "lag": 0, "error": f"slot {slot.name} does not exist"}
    end = max((m["lsn"] for m in wire.messages(found["confirmed"])), default=found["confirmed"])
    return {"name": slot.name, "active": True, "confirmed": found["confirmed"], "current": max(end, found["confirmed"]), "lag": max(0, end - found["confirmed"]), "error": None}


class _Range(InputPartition):
    def __init__(self, path: str, upto: int, position: Position):
        self.path, self.upto, self.position = path, upto, position


def rows_of(wire: RecordedWire, path: str, upto: int, position: Position) -> Iterator[tuple]:
    """A file's messages after a position and up to a place, with their transactions and relations."""
    known: dict[int, dict] = {}

    def relation_of(m: dict) -> dict | None:
        number = m.get("relation_id")
        if number not in known and (at := position.relations.get(number)) is not None:
            known[number] = wire.at(at, number)
        return known.get(number)

    def row(m: dict, txn: int | None) -> tuple:
        columns = lambda vs: None if vs is None else [(v["kind"], v.get("text")) for v in vs]
        named = relation_of(m) if m["kind"] in "IUD" else m
        r = named and named.get("relation")
        relation = r and (r["table"], [(c["name"], c["oid"], c["is_key"]) for c in r["columns"]])
        return (m["lsn"], m["kind"], m.get("xid", position.xid), _time(m.get("commit_ts")), m.get("relation_id"), relation, columns(m.get("values")), columns(m.get("old")), txn)

    for m in wire.read(path):
        if not position.lsn < m["lsn"] <= upto:
            continue
        if m["kind"] == "B" and position.begin is not None:
            # the source has started over: what was open never commits
            yield row({"lsn": m["lsn"], "kind": "A", "xid": position.xid}, position.begin)
        if m["kind"] == "R":
            known[m["relation_id"]] = m
        open_ = position.begin
        position = position.after(m)
        yield row(m, m["lsn"] if m["kind"] == "B" else open_)


def _time(text: str | None):
    from datetime import datetime

    return text and datetime.fromisoformat(text)


class Admission:
    """Lets waiting messages into a batch by their number or by the age of the first, whichever comes first."""

    def __init__(self, wire: Wire, events: int, age: float = 0.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.wire, self.events, self.age, self.clock, self.sleep = wire, events, age, clock, sleep
        self.since: float | None = None

    def waiting(self, start: Position) -> tuple[Position, int]:
        """The place where a batch from ``start`` has its changes, or the last one there is; and how many changes lie between."""
        n, end = 0, start
        for m in self.wire.messages(start.lsn):
            if self.events and n >= self.events and m["lsn"] > end.lsn:
                break
            n += m["kind"] in "IUD"
            end = end.after(m)
        return end, n

    def upto(self, start: Position) -> Position:
        """The end of the next batch. With too few changes waiting it waits for more, but no longer than ``age`` after the first was seen."""
        while True:
            end, n = self.waiting(start)
            if end.lsn == start.lsn:
                self.since = None
                return end
            self.since = self.clock() if self.since is None else self.since
            left = self.since + self.age - self.clock()
            if not self.events or n >= self.events or left <= 0:
                self.since = None
                return end
            self.sleep(min(left, 0.1))


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.wire = RecordedWire(options["path"])
        self.slot = Slot(options["slot"], options.get("name", "millrace"))
        self.admission = Admission(self.wire, int(options.get("events", "500")), float(options.get("age", "0")))
        self.slot.ensure()
        self.at = self.slot.position

    def initialOffset(self) -> dict:
        return self.slot.position.offset()

    def latestOffset(self) -> dict:
        self.at = self.admission.upto(self.at)
        return self.at.offset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A file a task, each with what is in force where it starts."""
        position, out = Position.of(start), []
        if end["lsn"] > self.at.lsn:
            self.at = Position.of(end)
        for _, path in self.wire.within(start["lsn"], end["lsn"]):
            out.append(_Range(path, end["lsn"], position))
            for m in self.wire.read(path):
                if position.lsn < m["lsn"] <= end["lsn"]:
                    position = position.after(m)
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from rows_of(self.wire, partition.path, partition.upto, partition.position)

    def commit(self, end: dict) -> None:
        done = Position.of(end).resumed.offset()
        self.slot.confirm(done["lsn"], done["carried"])


class RecordedWal(DataSource):
    """Options: ``path`` of the recording, ``slot`` folder and ``name``, ``events`` after which a batch ends (0: all there are), ``age`` in seconds that it waits for them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return STREAM

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream_wal(spark: SparkSession, path: str, slot: str, name: str = "millrace", events: int = 500, age: float = 0.0) -> DataFrame:
    """A stream of raw messages, resumed where the slot is; batches by size or age. Transactions may be cut: see ``streaming.transactions``."""
    spark.dataSource.register(RecordedWal)
    return spark.readStream.format(FORMAT).option("path", path).option("slot", slot).option("name", name).option("events", str(events)).option("age", str(age)).load()


def record(messages: list[dict], path: str) -> None:
    """Write messages as the next file of a recording; it appears as a whole."""
    files, folder = _files(path)
    files.create_dir(folder, recursive=True)
    name = f"{messages[0]['lsn']:020d}.jsonl"
    with files.open_output_stream(f"{folder}/.{name}.new") as f:
        f.write("".join(json.dumps(m) + "\n" for m in messages).encode())
    files.move(f"{folder}/.{name}.new", f"{folder}/{name}")
