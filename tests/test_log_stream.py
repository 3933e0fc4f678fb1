"""The raw log as a stream: transactions over several batches, restarts, slots, and rows that move from key to key."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.sources import log, registry, wal
from millrace.streaming import transactions
from millrace.streaming.replicate import Replicator, from_raw
from millrace.streaming.store import Store

TABLE = "public.things"
COLUMNS = [{"name": "id", "oid": 20, "is_key": True}, {"name": "a", "oid": 25, "is_key": False}, {"name": "b", "oid": 25, "is_key": False}]
MORE = [*COLUMNS, {"name": "z", "oid": 25, "is_key": False}]


def relation(lsn, columns=COLUMNS, number=7):
    return {"lsn": lsn, "kind": "R", "relation_id": number, "relation": {"table": TABLE, "columns": columns}}


def values(*texts):
    return [{"kind": "n"} if t is None else {"kind": "u"} if t == "~" else {"kind": "t", "text": str(t)} for t in texts]


class Source:
    """A table and the messages that its changes leave; transactions may be given up and begun anew."""

    def __init__(self, seed):
        self.rng, self.lsn, self.rows, self.messages, self.xid, self.width = random.Random(seed), 0, {}, [], 100, 2
        self.tell(relation(self.next()))

    def next(self):
        self.lsn += self.rng.choice((1, 1, 3, 10))
        return self.lsn

    def tell(self, m):
        self.messages.append(m)

    def change(self, rows):
        rng, fresh = self.rng, str(self.rng.randrange(1000))
        keys = sorted(rows)
        kind = rng.choice("IUUMMMD") if keys else "I"
        lsn = self.next()
        if kind == "I":
            i = rng.randrange(12)
            while i in rows:
                i += 1
            rows[i] = [fresh, rng.choice(["big" + fresh, None]), *(["z"] * (self.width - 2))]
            self.tell({"lsn": lsn, "kind": "I", "relation_id": 7, "values": values(i, *rows[i])})
        elif kind == "D":
            i = rng.choice(keys)
            del rows[i]
            self.tell({"lsn": lsn, "kind": "D", "relation_id": 7, "old": values(i, *[None] * self.width)})
        else:
            i = rng.choice(keys)
            row = rows.pop(i)
            to = i
            if kind == "M":
                to = rng.randrange(12)
                while to in rows:
                    to += 1
            row = [fresh, *row[1:]]
            sent = [fresh] + ["~" if v is not None and rng.random() < 0.8 else v for v in row[1:]]
            rows[to] = row
            self.tell({"lsn": lsn, "kind": "U", "relation_id": 7, "values": values(to, *sent), **({"old": values(i, *[None] * self.width)} if to != i else {})})

    def transaction(self, changes):
        rows = {k: list(v) for k, v in self.rows.items()}
        self.xid += 1
        self.tell({"lsn": self.next(), "kind": "B", "xid": self.xid})
        if self.rng.random() < 0.2 and self.width == 2 and len(self.messages) > 40:
            self.width = 3
            rows = {k: [*v, None] for k, v in rows.items()}
            self.tell(relation(self.next(), MORE))
        for _ in range(changes):
            self.change(rows)
        if self.rng.random() < 0.15:
            if self.width == len(next(iter(self.rows.values()), [0, 0])):
                return  # lost before its commit; the next begin gives it up
        self.rows = rows
        self.tell({"lsn": self.next(), "kind": "C", "xid": self.xid, "commit_ts": f"2024-01-01T00:00:{self.xid % 60:02d}+00:00"})


def history(seed, transactions_=14):
    s = Source(seed)
    for _ in range(transactions_):
        s.transaction(s.rng.choice((0, 1, 2, 5, 9)))
    return s


def raw_frame(spark, messages):
    """The whole log as a batch; rows name the transaction that is open, given-up ones get a number of their own."""
    out, xid = [], None
    for m in messages:
        if m["kind"] == "B":
            xid = m["xid"]
        r = m.get("relation")
        columns = lambda vs: None if vs is None else [(v["kind"], v.get("text")) for v in vs]
        out.append((m["lsn"], m["kind"], m.get("xid", xid), wal._time(m.get("commit_ts")), m.get("relation_id"), r and (r["table"], [(c["name"], c["oid"], c["is_key"]) for c in r["columns"]]), columns(m.get("values")), columns(m.get("old"))))
    return spark.createDataFrame(out, wal.RAW)


def things(path="log", columns=None):
    r = registry.Registry()
    r.add(registry.Table(TABLE, {"id": "bigint"}, columns or {"a": "string", "b": "string", "z": "string"}))
    return r


def state(df):
    return {r.id: [r.a, r.b, r.z] for r in df.collect()}


def want_of(source):
    return {k: [*v, None][:3] if len(v) == 2 else v for k, v in source.rows.items()}


def plain(rows):
    return sorted((r.op, r.table, r.lsn, str(r.commit_ts), sorted(r.pk.items()), sorted((r.after or {}).items(), key=str), sorted(r.unchanged or []), sorted((r.prev_pk or {}).items()), r.offset, r.sub) for r in rows)


def cut(messages, rng, files):
    """The log in files, cut anywhere."""
    at = sorted({0, len(messages), *(rng.randrange(1, len(messages)) for _ in range(files - 1))})
    return [messages[a:b] for a, b in zip(at, at[1:])]


@pytest.mark.parametrize(("seed", "events"), [(1, 3), (2, 7)])
def test_a_log_cut_anywhere_gives_the_same_rows(spark, tmp_path, seed, events):
    source = history(seed, 9)
    parts = cut(source.messages, random.Random(seed), 4)
    seen, batches = {}, []

    def sink(df, n):
        if n not in seen:
            batches.append(n)
        seen[n] = ingest.assembled(df).collect()

    def run():
        stream = transactions.committed(wal.stream_wal(spark, str(tmp_path / "log"), str(tmp_path / "slots"), events=events))
        from millrace.streaming.replicate import drained

        q = drained(stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).trigger(processingTime="0 seconds").start())
        q.awaitTermination()

    for i, part in enumerate(parts):
        wal.record(part, str(tmp_path / "log"))
        if i in (1, len(parts) - 1):  # each run is a restart
            run()
    want = ingest.assembled(raw_frame(spark, source.messages)).collect()
    got = [r for n in seen for r in seen[n]]
    assert plain(got) == plain(want) and not [r for r in got if r.error]
    assert len(batches) > 3


def test_one_shot_run_reads_all_there_is(spark, tmp_path):
    messages = [relation(0)]
    for t in range(3):
        messages += [{"lsn": 10 * t + 1, "kind": "B", "xid": t}, {"lsn": 10 * t + 2, "kind": "I", "relation_id": 7, "values": values(t, "x", "y")}, {"lsn": 10 * t + 3, "kind": "C", "xid": t, "commit_ts": "2024-01-01T00:00:00+00:00"}]
    wal.record(messages, str(tmp_path / "log"))
    store = Store(spark, "file://" + str(tmp_path / "store"), 2)
    for _ in range(2):
        stream = transactions.committed(wal.stream_wal(spark, str(tmp_path / "log"), str(tmp_path / "slots"), events=1))
        Replicator(store, things(), "q", decode=from_raw).start(stream, str(tmp_path / "cp")).awaitTermination()
        assert state(store.read(TABLE)) == {t: ["x", "y", None] for t in range(3)}


def test_log_survives_a_crash_between_commit_and_slot(spark, tmp_path):
    source = history(11, 6)
    wal.record(source.messages, str(tmp_path / "log"))
    store = Store(spark, "file://" + str(tmp_path / "store"), 2)
    n = []

    def failing(flush):
        n.append(flush)
        if len(n) == 3:
            raise RuntimeError("crash")

    def stream():
        return transactions.committed(wal.stream_wal(spark, str(tmp_path / "log"), str(tmp_path / "slots"), events=6))

    q = Replicator(store, things(), "q", decode=from_raw, on_flush=failing).start(stream(), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="crash"):
        q.awaitTermination()
    slot = wal.Slot(str(tmp_path / "slots"))
    assert slot.confirmed < source.messages[-1]["lsn"]
    Replicator(store, things(), "q", decode=from_raw).start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert state(store.read(TABLE)) == want_of(source)
    # a new checkpoint starts where the slot is, in the middle of the log, and changes nothing
    Replicator(store, things(), "again", decode=from_raw).start(stream(), str(tmp_path / "cp2")).awaitTermination()
    assert state(store.read(TABLE)) == want_of(source)
    # the slot is never within a transaction
    at = wal.Position.of({"lsn": slot.confirmed, "carried": slot._read()["carried"]})
    assert at.begin is None
    info = wal.slot_info(wal.RecordedWire(str(tmp_path / "log")), slot)
    assert info["lag"] == source.messages[-1]["lsn"] - slot.confirmed and info["active"]


def test_admission_by_size_or_age(tmp_path):
    path, now, slept = str(tmp_path / "log"), [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds
        if len(slept) == 3:
            wal.record([{"lsn": 30, "kind": "I"}], path)

    wire = wal.RecordedWire(path)
    a = wal.Admission(wire, 3, 1.0, lambda: now[0], sleep)
    assert a.upto(wal.Position()).lsn == -1 and not slept
    wal.record([relation(1), {"lsn": 2, "kind": "B", "xid": 1}, {"lsn": 3, "kind": "I"}], path)
    wal.record([{"lsn": 20, "kind": "I"}], path)
    at = a.upto(wal.Position())
    assert (at.lsn, at.begin, at.xid, at.relations) == (30, 2, 1, {7: 1}) and 0.2 < now[0] < 0.5  # enough have come before the age
    slept += [0.0] * 9
    wal.record([{"lsn": 40, "kind": "C", "xid": 1}], path)
    began = now[0]
    at = a.upto(at)
    assert at.lsn == 40 and at.begin is None and now[0] - began == pytest.approx(1.0)  # the age has come first
    assert wal.Position.of(at.offset()) == at
    one = wal.Admission(wire, 1)
    assert [one.upto(wal.Position()).lsn, one.upto(wal.Position(3)).lsn, one.upto(wal.Position(20)).lsn] == [3, 20, 30]


def test_files_are_left_out_by_name(tmp_path):
    path = str(tmp_path / "log")
    for first in (0, 10, 20, 30):
        wal.record([{"lsn": first + i, "kind": "I"} for i in range(3)], path)
    wire, opened = wal.RecordedWire(path), []
    read = wire.read
    wire.read = lambda p: opened.append(p) or read(p)
    assert [m["lsn"] for m in wire.messages(11, 21)] == [12, 20, 21] and len(opened) == 2
    odd = [{"lsn": 50, "kind": "I", "values": values("a b\x85c")}]
    wal.record(odd, path)
    (got,) = wal.RecordedWire(path).messages(40)
    assert got == odd[0]


def test_fresh_slot_gets_the_snapshot_once(spark, tmp_path):
    store, slot = Store(spark, "file://" + str(tmp_path / "store"), 2), wal.Slot(str(tmp_path / "slots"))
    rows = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "z")], "id long, a string, b string, z string")
    other = registry.Table("public.more", {"id": "bigint"}, {"a": "string"})
    tables = things()
    tables.add(other)
    rep = Replicator(store, tables, "q")
    broken = rows.select(F.raise_error("lost").cast("long").alias("id"), "a")
    with pytest.raises(Exception, match="lost"):
        rep.resume(slot, {"public.more": broken, TABLE: rows}, "2024-01-01")
    assert slot.ensure().fresh and not rep.backfilled("public.more")
    assert rep.resume(slot, {"public.more": rows.select("id", "a"), TABLE: rows}, "2024-01-01").fresh
    assert store.read(TABLE).count() == 2 == store.read("public.more").count()
    assert not rep.resume(slot, {TABLE: broken}, "2024-01-01").fresh


@pytest.mark.parametrize("seed", [21, 22, 23])
@pytest.mark.parametrize("way", ["raw", "log"])
def test_moved_rows_keep_what_was_not_resent(spark, tmp_path, seed, way):
    """Chains, swaps, moves onto freed keys and deletes between, in several batches, against the source's own table."""
    source = history(seed, 22)
    store = Store(spark, "file://" + str(tmp_path / "store"), 2)
    rep = Replicator(store, things(), "q")
    commits = [m["lsn"] for m in source.messages if m["kind"] == "C"]
    whole = ingest.assembled(raw_frame(spark, source.messages)).drop("error").persist()
    edges = [0, commits[len(commits) // 3], commits[-1]]
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = whole.where((F.col("lsn") > lo) & (F.col("lsn") <= hi))
        if way == "raw":
            rep.apply(part, n)
        else:
            log.publish(part, str(tmp_path / f"log{n}"), 3)
            rep.batch(log.read_log(spark, str(tmp_path / f"log{n}")), n)
    assert state(store.read(TABLE)) == want_of(source)


@pytest.mark.parametrize(("moves", "want"), [
    ([("1", "2"), ("2", "3")], {"3": "big1"}),
    ([("1", "9"), ("2", "1"), ("9", "2")], {"1": "big2", "2": "big1"}),
    ([("1", "2b"), ("2b", "3"), ("3", "4"), ("4", "5"), ("5", "6"), ("6", "1")], {"1": "big1"}),
    ([("1", "5"), ("5", None), ("2", "5")], {"5": "big2"}),
])
def test_chains(spark, moves, want):
    """Within one batch, from a replica: what the first key held is found however long the chain."""
    schema = "op string, table string, seq long, sub int, pk map<string,string>, after map<string,string>, unchanged array<string>, prev_pk map<string,string>"
    rows = []
    for n, (old, new) in enumerate(moves):
        rows.append(("d", "t", n, 0, {"id": old}, None, None, None))
        if new:
            rows.append(("c", "t", n, 1, {"id": new}, {"a": str(n)}, ["b"], {"id": old}))
    replica = spark.createDataFrame([("t", '{"id":"%d"}' % i, {"a": "0", "b": f"big{i}"}) for i in (1, 2)], "table string, k string, after map<string,string>")
    out = ingest.carry_key_changes(spark.createDataFrame(rows, schema), replica)
    last = {}
    for r in sorted(out.collect(), key=lambda r: (r.seq, r.sub)):
        last.pop(r.pk["id"], None)
        if r.op == "c":
            assert r.unchanged == [] and r.after["a"] == str(r.seq)
            last[r.pk["id"]] = r.after["b"]
    assert last == want
