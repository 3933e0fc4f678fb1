"""Store, streams, control, search, limits."""

import time
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import control
from millrace.functions import embed, text
from millrace.operators import documents, latency, usage, verify
from millrace.operators.documents import skipped
from millrace.plans import workload as w
from millrace.sources import errors, log, registry
from millrace.streaming import ratelimit
from millrace.streaming.replicate import DocumentWriter, Gate, Hold, Replicator
from millrace.streaming.store import Store
from tests.conftest import SF

USERS = registry.Table(w.USER_STATE, w.USER_KEYS, w.USER_COLUMNS)


@pytest.fixture
def tables():
    r = registry.Registry()
    r.add(USERS)
    return r


def state(df):
    return sorted((r.user_id, r.event_type, r.value, r.props) for r in df.collect())


def test_stream_equals_batch_and_survives_restarts(spark, tmp_path, tables):
    whole = w.event_log(spark, SF)
    # a history that a source can write: the first change of a key and after a delete resends all
    legal = whole.withColumn("after", F.when(F.col("op") != "d", F.map_concat(F.col("after"), F.when(F.array_contains("unchanged", "props"), F.create_map(F.lit("props"), F.lit("p"))).when(F.array_contains("unchanged", "value"), F.create_map(F.lit("value"), F.lit("1.0"))).otherwise(F.create_map().cast("map<string,string>"))))).withColumn("unchanged", F.array().cast("array<string>"))
    path = str(tmp_path / "log")
    for lo, hi in ((0, 300), (300, 650), (650, 10_000)):
        log.publish(legal.where((F.col("offset") >= lo) & (F.col("offset") < hi)).coalesce(1), path, 1)
        time.sleep(0.05)
    store = Store(spark, "file://" + str(tmp_path / "store"), buckets=4)
    flushes = []

    class Crash(Exception):
        pass

    def failing(flush):
        flushes.append(flush)
        if len(flushes) == 2:
            raise Crash

    first = Replicator(store, tables, "replica", on_flush=failing)
    q = first.start(log.stream_log(spark, path, 1), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="Crash"):
        q.awaitTermination()
    # the batch was committed, its offset was not: the restart replays it and it is skipped
    again = Replicator(store, tables, "replica")
    again.start(log.stream_log(spark, path, 1), str(tmp_path / "cp")).awaitTermination()
    want = state(w.applied(w.no_users(spark), legal))
    assert state(store.read(w.USER_STATE)) == want
    # a new checkpoint replays everything; the rows' LSNs guard them
    Replicator(store, tables, "rebuilt").start(log.stream_log(spark, path, 1), str(tmp_path / "cp2")).awaitTermination()
    assert state(store.read(w.USER_STATE)) == want
    assert store.clean() > 0 and state(store.read(w.USER_STATE)) == want


def test_backfill_then_changes(spark, tmp_path):
    r = registry.Registry()
    r.add(registry.Table("public.customer", w.CUSTOMER_KEYS, w.CUSTOMER_COLUMNS))
    store = Store(spark, "file://" + str(tmp_path / "s"), 4)
    rep = Replicator(store, r, "q")
    customer = w.table(spark, SF, "customer")
    rep.backfill({"public.customer": customer}, w.START)
    rep.backfill({"public.customer": customer}, w.START)
    source = (customer, ["c_custkey"])
    assert verify.all_match(verify.compare({"c": source}, {"c": (store.read("public.customer").select(*customer.columns), ["c_custkey"])})).first()[0]
    rep.apply(w.customer_changes(spark, SF), 0)
    assert not rep.apply(w.customer_changes(spark, SF), 0)
    want = w.customers(w.customer_changes(spark, SF), w.customers(w.customer_snapshot(spark, SF)))
    cols = ["c_custkey", "c_acctbal", "c_name"]
    assert sorted(map(tuple, store.read("public.customer").select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    service = control.Service(store, r, str(tmp_path / "errors"))
    assert not service.verify({"public.customer": customer})["matches"]
    assert service.usage()["tables"][0]["n_rows"] > 0 and service.latency("public.customer").endswith("s")


def test_documents_and_questions(spark, tmp_path, tables):
    path = str(tmp_path / "log")
    log.publish(w.event_log(spark, SF), path, 2)
    store = Store(spark, "file://" + str(tmp_path / "docs"), 2)
    hashed = embed.HashEmbedder(32)
    writer = DocumentWriter(store, tables, "docs", {w.USER_STATE: ["event_type"]}, lambda f: f.withColumn("text", F.concat(F.lit("user did "), F.col("event_type"))), lambda t: embed.hash_embed(t, 32))
    service = control.Service(store, tables, str(tmp_path / "errors"))
    with pytest.raises(LookupError, match="not ready"):
        service.ask("which click", "live", writer.VECTORS, hashed)
    writer.start(log.stream_log(spark, path), str(tmp_path / "cp")).awaitTermination()
    said = service.ask("the clicks", "live", writer.VECTORS, hashed)
    assert said["answer"] == "Closest record: user did click" and len(said["sources"]) >= 5
    with pytest.raises(LookupError, match="no snapshot"):
        service.ask("click", "batch", writer.VECTORS, hashed)
    store.snapshot(writer.VECTORS, writer.VECTORS + ".snapshot", now=5.0)
    assert service.ask("click", "batch", writer.VECTORS, hashed)["as_of"] == 5.0
    assert service.ask("zebra", "live", writer.VECTORS, hashed)["answer"].startswith("Closest record")
    for bad in ("", " ", "x" * 501):
        with pytest.raises(ValueError):
            service.ask(bad, "live", writer.VECTORS, hashed)


def test_hash_embedder(spark):
    e = embed.HashEmbedder(256)
    q, hit, miss = (np.array(v) for v in e.embed(["elephants near the river", "two elephants were seen near the river", "budget report for march"]))
    assert q @ hit > q @ miss and np.linalg.norm(hit) == pytest.approx(1, abs=1e-6) and embed.HashEmbedder(16).one("")[0] == 1
    assert embed.fnv1a("hello") == 0xA430D84680AABD0B
    features = ["", "a", "hello", "é" * 20, "x" * 64, "y" * 65, "hello there"]
    assert embed.fnv1a_many([f.encode() for f in features]).tolist() == [embed.fnv1a(f) for f in features]
    assert embed.literal([0.5, -1.0, 0.25]) == "[0.5,-1,0.25]"
    rows = spark.createDataFrame([("a b",), (None,)], "t string").select(embed.hash_embed(F.col("t"), 16).alias("v")).collect()
    assert [list(map(float, r.v)) for r in rows] == [embed.HashEmbedder(16).one(t).tolist() for t in ("a b", "")]
    one = spark.range(1).select(embed.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), embed.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), embed.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("n")).first()
    assert list(one.u) == [0.6, 0.8] and list(one.z) == [1.0, 0.0] and one.n is None
    with pytest.raises(ValueError):
        embed.check_dim(8, e)


def test_queries_in_blocks(spark):
    from millrace.operators.retrieve import vector_scores

    rows = w.table(spark, SF, "embeddings").where("vec_id < 12")
    vectors = rows.select(F.col("vec_id").alias("key"), "embedding")
    asked = rows.select(F.col("vec_id").alias("question_id"), "embedding")
    one, many = (sorted(map(tuple, vector_scores(vectors, asked, b).collect())) for b in (1000, 3))
    assert one == many and len(one) == 144


def test_text(spark):
    assert [text.stem(x) for x in ("running", "ponies", "classes", "hopped", "sing", "bus", "quickly")] == ["run", "poni", "class", "hop", "sing", "bus", "quick"]
    row = spark.range(1).select(
        documents.observation_text(F.lit(5), F.lit("Ada"), F.lit("Old Pond"), F.lit("2024"), F.lit("  ")).alias("o"),
        text.clip(F.lit("x" * 701)).alias("c"), text.meaningful(text.tokens(F.lit("The Big-Élan and 2 cats"))).alias("t"),
        skipped(F.lit("u"), F.array(F.lit("notes")), ["notes"]).alias("s1"), skipped(F.lit("c"), F.array(F.lit("notes")), ["notes"]).alias("s2"), skipped(F.lit("u"), F.array(F.lit("x")), ["notes"]).alias("s3"),
    ).first()
    assert row.o == "Observation 5 of Ada at Old Pond on 2024: no notes"
    assert len(row.c) == 703 and row.t == ["big", "élan", "2", "cats"] and (row.s1, row.s2, row.s3) == (True, False, False)


def test_wildlife_documents(spark):
    animals = spark.createDataFrame([(42, "Mosi", "blue_wildebeest")], "animal_id int, name string, species string")
    holes = spark.createDataFrame([(7, "Reed Lagoon")], "watering_hole_id int, name string")
    row = dict.fromkeys(("name", "species", "status", "home_watering_hole_id", "animal_id", "watering_hole_id", "observed_at", "notes"))
    rows = [
        ("public.animals", {"animal_id": "42"}, row | {"name": "Mosi", "species": "blue_wildebeest", "status": "adult", "home_watering_hole_id": "7"}),
        ("public.observations", {"observation_id": "5"}, row | {"animal_id": "42", "watering_hole_id": "8", "observed_at": "2024-01-01", "notes": " calm "}),
    ]
    df = spark.createDataFrame([(t, pk, *v.values()) for t, pk, v in rows], "table string, pk map<string,string>, " + ", ".join(f"{c} string" for c in row))
    assert sorted(r.text for r in documents.wildlife(df, animals, holes).collect()) == [
        "Mosi is a blue wildebeest, status adult, animal id 42. Home: Reed Lagoon (watering hole 7).",
        "Observation 5 of Mosi (blue wildebeest, animal 42) at watering hole 8 on 2024-01-01: calm",
    ]
    assert control.valid_place("the reed bed") and not control.valid_place("the moon")


def test_windows_and_pages():
    now = datetime(2024, 1, 1, 12, tzinfo=UTC)
    assert usage.parse_window(now=now) == (datetime(2024, 1, 1, 11, tzinfo=UTC), now)
    for bad in (("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("yesterday", None), ("2024-01-01T00:00:00", None)):
        with pytest.raises(ValueError):
            usage.parse_window(*bad)
    assert control.page_bounds("0", "-1") == (10, 0) and control.page_bounds("100", "7") == (100, 7) and control.page_bounds("101", None) == (10, 0)
    assert control.key_of({"id": 3.0}) == control.key_of({"id": "3"}) == 3
    for bad in ({}, {"a": 1, "b": 2}, {"a": 1.5}, {"a": "x"}, {"a": True}):
        with pytest.raises(ValueError):
            control.key_of(bad)
    a = control.Access("p", "secret", ("https://x",))
    assert a.allowed("Bearer secret") and not a.allowed("Bearer no") and a.origin("https://x") and not a.origin("https://y") and a.known("p") and not a.known("q")


def test_merge_times(spark):
    r = usage.merge_times(spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "at long, duration_ms double")).first()
    assert 50 <= r.p50_ms <= 51 and 95 <= r.p95_ms <= 96 and r.max_ms == r.last_ms == 100 and r.samples == 100
    assert usage.merge_times(spark.createDataFrame([], "at long, duration_ms double")).first().samples == 0


def test_error_log(spark, tmp_path):
    path = str(tmp_path / "e.jsonl")
    assert errors.read_errors(spark, path).count() == 0
    errors.append_error(path, "writer", "first", at=datetime(2024, 1, 1, tzinfo=UTC))
    errors.append_error(path, "writer", "second", "t", "why", at=datetime(2024, 1, 2, tzinfo=UTC))
    with open(path, "a") as f:
        f.write("not json\n")
    assert [r.message for r in errors.read_errors(spark, path).collect()] == ["second", "first"]
    assert [r.message for r in errors.read_errors(spark, path, 1).collect()] == ["second"]
    errors.append_error(str(tmp_path / "no" / "dir"), "writer", "lost")


def test_gates_and_holds(tmp_path):
    now = [0.0]
    g = Gate(lambda: now[0])
    g.pause(5)
    assert g.paused and g.phase(True) == "paused"
    now[0] = 6
    assert not g.paused and g.phase(True) == "streaming" and g.phase(False, True) == "backfill"
    g.pause(5)
    g.pause()
    now[0] = 60
    assert g.paused
    g.resume()
    assert not g.paused
    h = Hold(str(tmp_path / "hold"), 60, lambda: now[0])
    with h:
        with h:
            assert h.active()
        assert h.active()
    h.release()
    assert not h.active()
    with h:
        now[0] += 61
        assert not h.active() and not (tmp_path / "hold").exists()


def test_rate_limit(spark, tmp_path):
    rows = [("a", t * 1_000_000, t) for t in (0, 10, 20, 30, 59, 61, 65, 90)] + [("b", 5_000_000, 100)]
    want = {}
    for c in "ab":
        kept = []
        for _, t, i in sorted(r for r in rows if r[0] == c):
            want[i] = sum(x > t - 60_000_000 for x in kept) < 3
            kept += [t] if want[i] else []
    df = spark.createDataFrame(rows, "client string, at long, id long")
    assert {r.id: r.accepted for r in ratelimit.limited(df, 3).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ratelimit.limited_stream(stream, 3).writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.accepted for r in got} == want
    assert ratelimit.client_address("1.2.3.4, 5.6.7.8", "9.9.9.9:80") == "1.2.3.4" and ratelimit.client_address(None, "9.9.9.9:80") == "9.9.9.9"


def test_pokes_change_one_bucket(spark, tmp_path):
    """A visitor's writes: one bucket is rewritten, the change carries its own commit's LSN, a rival's commit is taken up."""
    source = Store(spark, "file://" + str(tmp_path / "source"), 8)
    rows = spark.range(100).select(F.col("id").alias("observation_id"), F.lit(1).cast("long").alias("animal_id"), F.lit(2).cast("long").alias("watering_hole_id"), F.timestamp_seconds("id").alias("observed_at"), F.lit("Seen, somewhere.").alias("notes"))
    source.commit({
        control.OBSERVATIONS: (rows, ["observation_id"], None),
        control.ANIMALS: (spark.createDataFrame([(1, "Ada", "grey_wolf")], "animal_id long, name string, species string"), ["animal_id"], None),
        control.HOLES: (spark.createDataFrame([(2, "Deep")], "watering_hole_id long, name string"), ["watering_hole_id"], None),
    })
    sent = []

    class Keep:
        def publish(self, changes):
            # another commit comes between the change's own and its publication
            source.commit({"other": (rows.limit(1), ["observation_id"], None)})
            sent.extend(changes.collect())

    demo = control.Demo(source, Keep(), lambda: 1000.0)
    before = source.manifest()
    demo.poke("c", {"observation_id": 9001})
    after = source.at(before["number"] + 1)
    files = lambda s: s["tables"][control.OBSERVATIONS]["files"]
    assert sum(files(before).get(b) != p for b, p in files(after).items()) == 1 and len(files(before)) == 8
    real, rival = source._publish, [True]

    def contested(base, made, *rest):
        if rival and control.OBSERVATIONS in made:
            rival.clear()
            real(base, {control.OBSERVATIONS: source._written(base, control.OBSERVATIONS, rows.where("observation_id < 50"), ["observation_id"], None, None)})
        return real(base, made, *rest)

    source._publish = contested
    demo.poke("c", {"observation_id": 9002}, documents.PLACES[2])
    source._publish = real
    held = {r.observation_id for r in source.read(control.OBSERVATIONS).collect()}
    assert held == {*range(50), 9002} and not rival
    demo.poke("u", {"observation_id": 9002}, documents.PLACES[1])
    demo.poke("d", {"observation_id": 9002})
    demo.poke("d", {"observation_id": 9002})
    assert [(r.op, r.pk["observation_id"]) for r in sent] == [("c", "9001"), ("c", "9002"), ("u", "9002"), ("d", "9002")]
    assert [r.lsn for r in sent] == sorted({r.lsn for r in sent}) and sent[0].lsn == before["number"] + 1
    assert documents.PLACES[1] in sent[2].after["notes"]
    for bad in (("x", {"observation_id": 9001}), ("u", {"id": 1}), ("u", {"observation_id": 5}), ("d", {"observation_id": 3_000_000_001})):
        with pytest.raises(ValueError):
            demo.poke(*bad, documents.PLACES[0])
    with pytest.raises(LookupError):
        demo.poke("u", {"observation_id": 9009}, documents.PLACES[0])


def test_limit_forgets_clients(spark, tmp_path):
    """Over many batches the stream decides as the batch form does, and its state holds the clients of the last minutes only."""
    second = 1_000_000
    rows = [(f"c{n // 40}", (n * 3 + n % 2) * second, n) for n in range(400)]  # ten clients one after the other, two minutes each
    rows += [("busy", n * 5 * second, 1000 + n) for n in range(240)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "client string, at long, id long"
    want = {r.id: r.accepted for r in ratelimit.limited(spark.createDataFrame(rows, schema), 5).collect()}
    size = len(rows) // 4
    for i in range(4):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    got, held = [], []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ratelimit.limited_stream(stream, 5, late="10 seconds").writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert {r.id: r.accepted for r in got} == want and len(got) == len(rows) and not all(want.values())
    # a value and its timer for each client that still counts: far from all eleven
    assert held[-1] <= 8


def test_latency_report(spark, tmp_path):
    rows = w.applied_events(spark, SF)
    assert latency.report(rows).startswith("1000 rows, avg 2.") and "max 4 s" in latency.report(rows)
    with pytest.raises(ValueError):
        latency.report(rows.limit(0))
    latency.write_csv(latency.by_minute(rows), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["minute", "n_rows", "avg_s", "p95_s", "max_s"]


def test_stems_are_those_of_the_public_algorithm():
    want = {
        "consign": "consign", "consigned": "consign", "consignment": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol", "console": "consol",
        "consolatory": "consolatori", "consolingly": "consol", "consols": "consol", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir", "constable": "constabl",
        "constancy": "constanc", "consternation": "constern", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knightly": "knight",
        "knives": "knive", "knots": "knot", "knocker": "knocker", "knowledge": "knowledg", "skies": "sky", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi",
        "hoping": "hope", "hopping": "hop", "luxuriated": "luxuri", "by": "by", "say": "say", "cry": "cri", "youth": "youth", "boy": "boy", "generally": "general", "communism": "communism",
        "proceed": "proceed", "agreed": "agre", "feed": "feed", "rationalization": "ration", "hopefulness": "hope", "sensibility": "sensibl", "roll": "roll", "controll": "control", "été": "été", "is": "is", "": "",
    }
    assert {x: text.stem(x) for x in want} == want
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 127


def test_settings_and_registry(spark):
    s = registry.Settings.load({"MILLRACE_FLUSH_EVENTS": "12", "MILLRACE_FLUSH_SECONDS": "1m30s", "MILLRACE_VECTOR_DIM": "-3", "MILLRACE_TOPIC": "x"})
    assert (s.flush_events, s.flush_seconds, s.vector_dim, s.topic) == (12, 90.0, 1536, "x")
    with pytest.raises(ValueError):
        registry.Table("t", {}, {})
    t = registry.Registry.described(spark.range(1).withColumn("a", F.lit("x")), "t", ["id"])
    assert t.ordered == ["id", "a"] and t.keys == {"id": "bigint"}
    assert verify.converge(lambda: False, 0) is False and verify.short("0123456789") == "01234567"
