"""Change logs and replicas derived from the given tables by pure expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.fold import fold, key_columns, typed
from millrace.operators.ingest import snapshot_events
from millrace.operators.merge import APPLY_TS, COMMIT_TS, LSN, empty_replica, merge

USER_STATE = "public.user_state"
USER_KEYS, USER_COLUMNS = {"user_id": "bigint"}, {"event_type": "string", "props": "string", "value": "double"}
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of one row a user: signups create, errors delete, clicks leave props and views value unsent."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    op = F.when(kind == "signup", "c").when(kind == "error", "d").otherwise("u")
    value, text = F.col("value").cast("string"), F.map_from_arrays
    after = (
        F.when(kind == "click", text(F.array(F.lit("event_type"), F.lit("value")), F.array("event_type", value)))
        .when(kind == "view", text(F.array(F.lit("event_type"), F.lit("props")), F.array("event_type", "props")))
        .when(kind != "error", text(F.array(F.lit("event_type"), F.lit("value"), F.lit("props")), F.array(F.col("event_type"), value, F.col("props"))))
    )
    unchanged = F.when(kind == "click", F.array(F.lit("props"))).when(kind == "view", F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    types = F.create_map(*[F.lit(x) for x in ("user_id", "bigint", "event_type", "text", "value", "double precision", "props", "text")])
    return e.select(
        op.alias("op"),
        F.lit(USER_STATE).alias("table"),
        F.col("event_id").alias("lsn"),
        F.col("ts").alias("commit_ts"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("pk"),
        after.alias("after"),
        unchanged.alias("unchanged"),
        types.alias("types"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def folded_users(log: DataFrame) -> DataFrame:
    return typed(key_columns(fold(log, sorted(USER_COLUMNS)), USER_KEYS), USER_COLUMNS)


def applied(replica: DataFrame, log: DataFrame, guard: bool = True) -> DataFrame:
    return merge(replica, folded_users(log), ["user_id"], sorted(USER_COLUMNS), F.lit(START), guard)


def no_users(spark: SparkSession) -> DataFrame:
    return empty_replica(spark, USER_KEYS, USER_COLUMNS)


CUSTOMER_KEYS = {"c_custkey": "bigint"}
CUSTOMER_COLUMNS = {"c_acctbal": "double", "c_mktsegment": "string", "c_name": "string", "c_nationkey": "int"}


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = snapshot_events(table(spark, sf_dir, "customer"), "public.customer", ["c_custkey"], START)
    return events.withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0).cast("long"))


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balance from every order, and a delete from every 97th."""
    o = table(spark, sf_dir, "orders")
    gone = F.col("o_orderkey") % 97 == 0
    rest = [c for c in sorted(CUSTOMER_COLUMNS) if c != "c_acctbal"]
    return o.select(
        F.when(gone, "d").otherwise("u").alias("op"),
        F.lit("public.customer").alias("table"),
        (F.col("o_orderkey") + 1).alias("lsn"),
        F.col("o_orderdate").cast("timestamp").alias("commit_ts"),
        F.create_map(F.lit("c_custkey"), F.col("o_custkey").cast("string")).alias("pk"),
        F.when(~gone, F.create_map(F.lit("c_acctbal"), F.round(F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(2,2)"), 2).cast("string"))).alias("after"),
        F.when(~gone, F.array(*[F.lit(c) for c in rest])).alias("unchanged"),
        F.create_map(F.lit("c_custkey"), F.lit("bigint")).alias("types"),
        F.lit(0).alias("partition"),
        (F.col("o_orderkey") + 1).alias("offset"),
    )


def customers(changes: DataFrame, replica: DataFrame | None = None) -> DataFrame:
    spark = changes.sparkSession
    f = typed(key_columns(fold(changes, sorted(CUSTOMER_COLUMNS)), CUSTOMER_KEYS), CUSTOMER_COLUMNS)
    start = empty_replica(spark, CUSTOMER_KEYS, CUSTOMER_COLUMNS) if replica is None else replica
    return merge(start, f, ["c_custkey"], sorted(CUSTOMER_COLUMNS), F.lit(START))


def applied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a replica with commit and application times."""
    ts = F.col("ts").cast("timestamp")
    micros = F.unix_micros(ts) + (F.col("event_id") % 40) * 100_000 + 500_000
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", ts.alias(COMMIT_TS), F.timestamp_micros(micros).alias(APPLY_TS), F.col("event_id").alias(LSN))


def _message(lsn, kind: str, xid=None, commit_ts=None, relation_id=None, relation=None, values=None, old=None) -> list:
    tuple_type = "array<struct<kind:string,text:string>>"
    relation_type = "struct<table:string,columns:array<struct<name:string,oid:int,is_key:boolean>>>"
    pick = lambda c, t, n: (F.lit(None) if c is None else c).cast(t).alias(n)
    return [pick(lsn, "long", "lsn"), F.lit(kind).alias("kind"), pick(xid, "long", "xid"), pick(commit_ts, "timestamp", "commit_ts"), pick(relation_id, "long", "relation_id"), pick(relation, relation_type, "relation"), pick(values, tuple_type, "values"), pick(old, tuple_type, "old")]


def relation_message(spark: SparkSession, relation_id: int, name: str, columns: list[tuple[str, int, bool]], lsn: int = 0) -> DataFrame:
    cols = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("oid"), F.lit(k).alias("is_key")) for n, o, k in columns])
    return spark.range(1).select(*_message(F.lit(lsn), "R", relation_id=F.lit(relation_id), relation=F.struct(F.lit(name).alias("table"), cols.alias("columns"))))


def sent(value):
    """A positional value: text, or null."""
    text = value.cast("string")
    return F.struct(F.when(text.isNull(), "n").otherwise("t").alias("kind"), text.alias("text"))


def unsent():
    return F.struct(F.lit("u").alias("kind"), F.lit(None).cast("string").alias("text"))


USER_RELATION = [("user_id", 20, True), ("event_type", 25, False), ("value", 701, False), ("props", 25, False)]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of users as raw messages: transactions of seven events, every eleventh of which never commits."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("xid", F.floor(F.col("event_id") / 7))
    kind, key, at = F.col("event_type"), F.col("user_id"), 2 * F.col("event_id") + 1
    value, props = sent(F.col("value")), sent(F.col("props"))
    new = F.array(sent(key), sent(kind), F.when(kind == "view", unsent()).otherwise(value), F.when(kind == "click", unsent()).otherwise(props))
    old = F.array(sent(key), *[sent(F.lit(None).cast("string"))] * 3)
    one = lambda k, rows, values=None, old=None: rows.select(*_message(at, k, F.col("xid"), None, F.lit(1), None, values, old))
    commits = e.groupBy("xid").agg(F.max("event_id").alias("last"), F.max_by("ts", "event_id").alias("ts")).where("xid % 11 <> 0")
    parts = [
        relation_message(spark, 1, USER_STATE, USER_RELATION),
        one("I", e.where(kind == "signup"), new), one("D", e.where(kind == "error"), None, old), one("U", e.where(~kind.isin("signup", "error")), new),
        e.groupBy("xid").agg(F.min("event_id").alias("first")).select(*_message(2 * F.col("first"), "B", F.col("xid"))),
        commits.select(*_message(2 * F.col("last") + 2, "C", F.col("xid"), F.col("ts"))),
        e.where("event_id % 13 = 0").select(*_message(at, "T", F.col("xid"), relation_id=F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ORDER_KEYS, ORDER_COLUMNS = {"o_orderkey": "bigint"}, {"o_orderpriority": "string", "o_orderstatus": "string"}


def raw_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order inserted, and every fiftieth then given another key and status while its priority is not resent."""
    o = table(spark, sf_dir, "orders")
    k, empty = F.col("o_orderkey"), sent(F.lit(None).cast("string"))
    first = F.array(sent(k), sent(F.col("o_orderstatus")), sent(F.col("o_orderpriority")))
    then = F.array(sent(k + 10_000_000), sent(F.lit("M")), unsent())
    moved = o.where(k % 50 == 0)
    ts = F.col("o_orderdate").cast("timestamp")
    return (
        relation_message(spark, 1, "public.orders", [("o_orderkey", 20, True), ("o_orderstatus", 25, False), ("o_orderpriority", 25, False)])
        .unionByName(o.select(*_message(4 * k + 1, "I", k, None, F.lit(1), None, first)))
        .unionByName(moved.select(*_message(4 * k + 2, "U", k, None, F.lit(1), None, then, F.array(sent(k), empty, empty))))
        .unionByName(o.select(*_message(4 * k + 3, "C", k, ts)))
    )


def raw_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order inserted; of 50, one then moves to three other keys in turn, one moves away and back, one moves twice and is deleted.

    No move resends the priority, and each is a transaction of its own.
    """
    o = table(spark, sf_dir, "orders")
    k, empty, ts = F.col("o_orderkey"), sent(F.lit(None).cast("string")), F.col("o_orderdate").cast("timestamp")
    first = F.array(sent(k), sent(F.col("o_orderstatus")), sent(F.col("o_orderpriority")))
    far = lambda n: k + n * 10_000_000

    def move(rows, place, old, new, status):
        update = rows.select(*_message(100 * k + place, "U", 10 * k + place, None, F.lit(1), None, F.array(sent(new), sent(F.lit(status)), unsent()), F.array(sent(old), empty, empty)))
        return update.unionByName(rows.select(*_message(100 * k + place + 1, "C", 10 * k + place, ts)))

    on, back, gone = o.where(k % 50 == 0), o.where(k % 50 == 3), o.where(k % 50 == 7)
    out = relation_message(spark, 1, "public.orders", [("o_orderkey", 20, True), ("o_orderstatus", 25, False), ("o_orderpriority", 25, False)])
    for part in (
        o.select(*_message(100 * k + 1, "I", 10 * k, None, F.lit(1), None, first)), o.select(*_message(100 * k + 2, "C", 10 * k, ts)),
        move(on, 3, k, far(1), "1"), move(on, 5, far(1), far(2), "2"), move(on, 7, far(2), far(3), "3"),
        move(back, 3, k, far(1), "A"), move(back, 5, far(1), k, "B"),
        move(gone, 3, k, far(1), "X"), move(gone, 5, far(1), far(2), "Y"),
        gone.select(*_message(100 * k + 7, "D", 10 * k + 7, None, F.lit(1), None, None, F.array(sent(far(2)), empty, empty))), gone.select(*_message(100 * k + 8, "C", 10 * k + 7, ts)),
    ):
        out = out.unionByName(part)
    return out


def generated(spark: SparkSession, n: int, width: int = 200) -> DataFrame:
    """(id, payload): rows of filler text that depend on their id alone."""
    return spark.range(n).select("id", F.substring(F.repeat(F.md5(F.col("id").cast("string").cast("binary")), -(-width // 32)), 1, width).alias("payload"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a local session without that gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/millrace-{uuid.uuid4().hex}"


def error_log(spark: SparkSession, sf_dir: str) -> str:
    """The error events written as an error log's lines; where it is. Services are numbered so that later events come first among equal times."""
    at = scratch_folder(spark)
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    e.select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.lpad((F.lit(10**12) - F.col("event_id")).cast("string"), 13, "0").alias("service"),
        F.lit(USER_STATE).alias("table"), F.col("props").alias("message"), F.col("event_id").cast("string").alias("errorDetail"),
    ).write.json(at)
    return at
