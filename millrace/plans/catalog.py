"""The queries of the library, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import control, schema
from millrace.functions import embed, text
from millrace.operators import codec, digests, documents, ingest, latency, retrieve, usage, verify
from millrace.operators import fold as folds
from millrace.operators.merge import APPLY_TS, COMMIT_TS, LSN, empty_replica, merge
from millrace.operators.nearest import nearest
from millrace.operators.scratch import staged
from millrace.plans import workload as w
from millrace.sources import registry
from millrace.sources.errors import read_errors
from millrace.streaming.keyword_index import KeywordIndex
from millrace.streaming.ratelimit import limited
from millrace.streaming.replicate import from_raw
from millrace.streaming.store import Store
from millrace.streaming.vector_index import VectorIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The derived change log of users, for SQL.
LOG = (
    "log AS (SELECT event_id AS pos, user_id, event_type, value, props, CAST(epoch_us(ts) AS BIGINT) AS at_us, "
    "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, "
    "CASE event_type WHEN 'click' THEN 'props' WHEN 'view' THEN 'value' ELSE '' END AS unsent FROM events)"
)
#: Its fold: the last change, and for each column the last change that says something on it.
FOLD = (
    LOG + ", f AS (SELECT user_id, max(pos) AS pos, arg_max(op, pos) AS op, arg_max(event_type, pos) AS event_type, arg_max(unsent, pos) AS unsent, arg_max(at_us, pos) AS at_us, "
    "arg_max(op, pos) FILTER (unsent <> 'value') AS value_op, arg_max(value, pos) FILTER (unsent <> 'value') AS value, "
    "arg_max(op, pos) FILTER (unsent <> 'props') AS props_op, arg_max(props, pos) FILTER (unsent <> 'props') AS props FROM log GROUP BY user_id), "
    "folded AS (SELECT user_id, pos, op, at_us, CASE WHEN op <> 'd' THEN event_type END AS event_type, "
    "CASE WHEN op <> 'd' AND value_op <> 'd' THEN value END AS value, CASE WHEN op <> 'd' AND props_op <> 'd' THEN props END AS props, "
    "CASE WHEN op <> 'd' AND unsent = 'value' AND coalesce(value_op, 'd') = 'd' THEN 'value' WHEN op <> 'd' AND unsent = 'props' AND coalesce(props_op, 'd') = 'd' THEN 'props' ELSE '' END AS still_unchanged FROM f)"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("SELECT event_id AS pos, user_id, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, CAST(epoch_us(ts) AS BIGINT) AS at_us, CASE WHEN event_type NOT IN ('error', 'click') THEN props END AS props, CASE event_type WHEN 'click' THEN 'props' WHEN 'view' THEN 'value' ELSE '' END AS unchanged FROM events")
def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes written as messages and read back."""
    back = codec.decoded(codec.encoded(w.event_log(spark, sf_dir)))
    return back.select(F.col("offset").alias("pos"), F.try_element_at("pk", F.lit("user_id")).cast("long").alias("user_id"), "op", micros("commit_ts").alias("at_us"), F.try_element_at("after", F.lit("props")).alias("props"), F.concat_ws(",", "unchanged").alias("unchanged"))


@query("SELECT event_id AS pos, CASE event_id % 5 WHEN 0 THEN 'not an event' WHEN 1 THEN 'no op' WHEN 2 THEN 'no table' ELSE 'unknown op' END AS error FROM events WHERE event_id % 5 <> 4")
def envelope_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are no change, with the reason."""
    n = F.col("event_id") % 5
    op = F.when(n == 1, "").when(n == 3, "x").otherwise("c")
    value = F.when(n == 0, "{not json").otherwise(F.to_json(F.struct(op.alias("op"), F.when(n == 2, "").otherwise("t").alias("table"))))
    messages = w.table(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), value.alias("value"))
    return codec.rejected(messages).select(F.col("offset").alias("pos"), "error")


@query("""SELECT DISTINCT 'public.lineitem:{"l_linenumber":"' || l_linenumber || '","l_orderkey":"' || l_orderkey || '"}' AS key FROM lineitem""")
def message_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of messages; their columns are in order whatever the map's."""
    pk = F.create_map(F.lit("l_orderkey"), F.col("l_orderkey").cast("string"), F.lit("l_linenumber"), F.col("l_linenumber").cast("string"))
    return w.table(spark, sf_dir, "lineitem").select(codec.message_key(F.lit("public.lineitem"), pk).alias("key")).distinct()


@query(
    "SELECT CAST(oid AS BIGINT) AS oid, CASE oid "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in schema.TYPE_NAMES.items())
    + " ELSE 'text' END AS type_name, CASE oid "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in schema.TYPE_NAMES.items())
    + " ELSE 'text' END AS replica_type FROM range(4000) AS t(oid)"
)
def typemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type numbers, their names, and the replica's types."""
    named = spark.range(4000).select(F.col("id").alias("oid"), schema.type_name(F.col("id")).alias("type_name"))
    return named.withColumn("replica_type", schema.replica_type(F.col("type_name")))


@query("WITH t AS (SELECT *, event_id // 7 AS xid FROM events), c AS (SELECT xid, max(event_id) AS lsn, arg_max(CAST(epoch_us(ts) AS BIGINT), event_id) AS at_us FROM t GROUP BY xid) SELECT event_id, xid, lsn, at_us FROM t JOIN c USING (xid) WHERE xid % 11 <> 0")
def tx_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of committed transactions with their commit's LSN and time."""
    e = w.table(spark, sf_dir, "events").withColumn("xid", F.floor(F.col("event_id") / 7))
    commits = e.groupBy("xid").agg(F.max("event_id").alias("lsn"), F.max_by("ts", "event_id").cast("timestamp").alias("commit_ts")).where("xid % 11 <> 0")
    return ingest.stamp_commits(e.select("event_id", "xid"), commits).select("event_id", "xid", "lsn", micros("commit_ts").alias("at_us"))


@query(
    "SELECT o_orderkey AS pos, 0 AS sub, CASE WHEN o_orderkey % 50 = 0 THEN 'd' ELSE 'u' END AS op, o_orderkey AS key, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END AS status FROM orders "
    "UNION ALL SELECT o_orderkey, 1, 'c', o_orderkey + 10000000, o_orderstatus FROM orders WHERE o_orderkey % 50 = 0"
)
def pk_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-changing updates as a delete and a create."""
    key = F.col("o_orderkey")
    moved = F.when(key % 50 == 0, key + 10_000_000).otherwise(key)
    changes = w.table(spark, sf_dir, "orders").select(
        key.alias("pos"), F.lit("u").alias("op"),
        F.create_map(F.lit("o_orderkey"), moved.cast("string")).alias("pk"),
        F.create_map(F.lit("o_orderkey"), key.cast("string")).alias("old_pk"),
        F.create_map(F.lit("o_orderstatus"), F.col("o_orderstatus")).alias("after"), F.array().cast("array<string>").alias("unchanged"),
    )
    out = ingest.split_key_changes(changes)
    return out.select("pos", "sub", "op", F.try_element_at("pk", F.lit("o_orderkey")).cast("long").alias("key"), F.try_element_at("after", F.lit("o_orderstatus")).alias("status"))


@query("SELECT 't' || (o_orderkey % 3) AS table_name, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 2 THEN 'unknown relation' WHEN o_orderkey % 7 = 0 THEN 'wrong number of values' END AS error, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'status' ELSE '' END AS unchanged FROM orders")
def decode_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional tuples with their relations: key, values, unchanged columns, or an error."""
    relations = spark.createDataFrame([(n, f"t{n}", [("id", 20, True), ("status", 25, False)]) for n in (0, 1)], "relation_id long, table string, columns array<struct<name:string,oid:int,is_key:boolean>>")
    k = F.col("o_orderkey")
    value = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    second = F.when(k % 5 == 0, value("u", F.lit(None).cast("string"))).otherwise(value("t", F.col("o_orderstatus")))
    values = F.when(k % 7 == 0, F.array(value("t", k.cast("string")))).otherwise(F.array(value("t", k.cast("string")), second))
    tuples = w.table(spark, sf_dir, "orders").select(k.alias("xid"), k.alias("seq"), F.lit("update").alias("action"), (k % 3).alias("relation_id"), values.alias("values"), F.lit(None).cast("array<struct<kind:string,text:string>>").alias("old"))
    out = ingest.decode_tuples(tuples, relations)
    return out.select(F.concat(F.lit("t"), F.col("seq") % 3).alias("table_name"), F.col("seq").alias("pos"), "error", F.try_element_at("pk", F.lit("id")).cast("long").alias("id"), F.try_element_at("after", F.lit("status")).alias("status"), F.concat_ws(",", "unchanged").alias("unchanged"))


@query("SELECT 'r' AS op, c_custkey, CAST(0 AS BIGINT) AS lsn, c_name, c_mktsegment FROM customer")
def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows as snapshot events."""
    get = lambda m, c: F.try_element_at(m, F.lit(c))
    return w.customer_snapshot(spark, sf_dir).select("op", get("pk", "c_custkey").cast("long").alias("c_custkey"), "lsn", get("after", "c_name").alias("c_name"), get("after", "c_mktsegment").alias("c_mktsegment"))


@query("WITH " + FOLD + " SELECT user_id, pos, op FROM folded")
def fold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each key."""
    return w.folded_users(w.event_log(spark, sf_dir)).select("user_id", F.col("offset").alias("pos"), "op")


@query("WITH " + FOLD + " SELECT user_id, op, event_type, value, props, still_unchanged FROM folded")
def fold_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded values, with unsent columns carried forward where they are known."""
    return w.folded_users(w.event_log(spark, sf_dir)).select("user_id", "op", "event_type", "value", "props", F.concat_ws(",", "still_unchanged").alias("still_unchanged"))


@query("SELECT 'public.user_state' AS table_name, min(event_id) AS pos, arg_min(CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END, event_id) AS op, CAST(4 AS INTEGER) AS n_types FROM events WHERE user_id % 4 = 0")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change whose types shape a batch: the first of the widest."""
    r = folds.representative(w.event_log(spark, sf_dir))
    return r.select(F.col("table").alias("table_name"), F.col("offset").alias("pos"), "op", F.size("types").alias("n_types"))


_REPLICA = " SELECT user_id, event_type, value, props, at_us, pos AS lsn FROM folded WHERE op <> 'd'"


def _users(replica: DataFrame) -> DataFrame:
    return replica.select("user_id", "event_type", "value", "props", micros(COMMIT_TS).alias("at_us"), F.col(LSN).alias("lsn"))


@query("WITH " + FOLD + _REPLICA)
def merge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of every key: the log folded and merged into an empty replica."""
    return _users(w.applied(w.no_users(spark), w.event_log(spark, sf_dir)))


@query("WITH " + FOLD + _REPLICA)
def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log merged twice."""
    log = w.event_log(spark, sf_dir)
    return _users(w.applied(w.applied(w.no_users(spark), log), log))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 97 = 0)")
def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes remove rows; those of absent rows are ignored."""
    base = w.customers(w.customer_snapshot(spark, sf_dir))
    gone = w.customer_changes(spark, sf_dir).where("op = 'd'")
    return w.customers(gone, w.customers(gone, base)).select("c_custkey", "c_name")


@query(
    "WITH ch AS (SELECT o_custkey AS k, o_orderkey AS pos, CASE WHEN o_orderkey % 97 = 0 THEN 'd' ELSE 'u' END AS op, CAST(round(CAST(o_totalprice AS DECIMAL(18, 2)) * 0.01, 2) AS DOUBLE) AS bal FROM orders), "
    "l AS (SELECT k, arg_max(op, pos) AS op, arg_max(bal, pos) AS bal, max(pos) FILTER (op = 'd') AS dead FROM ch GROUP BY k) "
    "SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN l.k IS NULL THEN c_acctbal ELSE bal END AS c_acctbal, CASE WHEN TRUE THEN c_name END AS c_name FROM customer FULL JOIN l ON c_custkey = k WHERE l.k IS NULL OR op <> 'd'"
)
def backfill_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, then updates and deletes. A batch's fold is merged once, so unsent columns keep the replica's values."""
    out = w.customers(w.customer_changes(spark, sf_dir), w.customers(w.customer_snapshot(spark, sf_dir)))
    return out.select("c_custkey", "c_acctbal", "c_name")


def _checksum_sql(name: str, cols: str, key: str, where: str = "") -> str:
    return f"SELECT count(*) AS n, md5(coalesce(string_agg(md5({cols}), '' ORDER BY CAST({key} AS VARCHAR)), '')) AS digest FROM {name}{where}"


_NATION = "n_nationkey || '|' || n_name || '|' || n_regionkey"


@query(_checksum_sql("nation", _NATION, "n_nationkey").replace("AS n,", "AS n_rows,"))
def table_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digest of a table."""
    return verify.checksum(w.table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("SELECT count(*) AS n_rows FROM orders")
def additive_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of the order-free checksum; its hashes agree with those of the same rows in another order."""
    o = w.table(spark, sf_dir, "orders")
    a, b = verify.additive_checksum(o, ["o_orderkey"]), verify.additive_checksum(o.repartition(7, "o_custkey"), ["o_orderkey"])
    return a.join(b, ["n_rows", "hash_sum", "hash_xor"]).select("n_rows")


def _digest(name: str, cols: str, key: str, where: str = "") -> str:
    return f"SELECT '{name}' AS table_name, n AS source_rows, digest AS source_digest FROM ({_checksum_sql(name, cols, key, where)})"


_REGION = "r_regionkey || '|' || r_name"


@query(" UNION ALL ".join(f"SELECT table_name, source_rows, source_digest, source_rows AS replica_rows, source_digest AS replica_digest, TRUE AS matches FROM ({_digest(n, c, k)})" for n, c, k in (("nation", _NATION, "n_nationkey"), ("region", _REGION, "r_regionkey"))))
def verify_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against equal copies."""
    tables = {n: (w.table(spark, sf_dir, n), [k]) for n, k in (("nation", "n_nationkey"), ("region", "r_regionkey"))}
    return verify.compare(tables, tables, exact=True)


@query(
    "WITH s AS (" + _digest("nation", _NATION, "n_nationkey") + "), d AS (SELECT n AS replica_rows, digest AS replica_digest FROM ("
    + _checksum_sql("nation", "n_nationkey || '|' || CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END || '|' || n_regionkey", "n_nationkey", " WHERE n_nationkey <> 5")
    + ")) SELECT *, FALSE AS matches FROM s, d UNION ALL SELECT table_name, source_rows, source_digest, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), FALSE FROM (" + _digest("region", _REGION, "r_regionkey") + ")"
)
def verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a copy with a changed and a missing row, and one that can't be read."""
    n = w.table(spark, sf_dir, "nation")
    bad = n.where("n_nationkey <> 5").withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name")))
    return verify.compare({"nation": (n, ["n_nationkey"]), "region": (w.table(spark, sf_dir, "region"), ["r_regionkey"])}, {"nation": (bad, ["n_nationkey"])}, exact=True)


@query(
    "SELECT o_orderkey, CASE o_orderkey % 1000 WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' END AS difference FROM orders WHERE o_orderkey % 1000 IN (1, 2) "
    "UNION ALL SELECT o_orderkey + 1000000000, 'extra' FROM orders WHERE o_orderkey % 1000 = 3"
)
def verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of orders that a copy with changed, missing and extra rows differs in, found down a tree of digests."""
    o = w.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    copy = o.where(k % 1000 != 2).withColumn("o_totalprice", F.when(k % 1000 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    copy = copy.unionByName(o.where(k % 1000 == 3).withColumn("o_orderkey", k + 1_000_000_000))
    return digests.differences(o, copy.repartition(5, "o_custkey"), ["o_orderkey"])


_DIGEST_LEAF = (
    "SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2)) AS BIGINT) AS node, CAST(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || CAST(epoch_us(o_orderdate) AS BIGINT) || '|' || "
    "o_orderpriority || '|' || o_orderstatus || '|' || CAST(o_totalprice AS DECIMAL(38, 6))), 1, 15)) AS BIGINT) AS h FROM orders"
)


@query("SELECT node, count(*) AS n_rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (" + _DIGEST_LEAF + ") GROUP BY node")
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second level of the tree of digests of orders, made from the leaves."""
    level = digests.tree(w.table(spark, sf_dir, "orders"), ["o_orderkey"])[2]
    return level.select("node", F.col("n").alias("n_rows"), F.col("hash_sum").cast("string").alias("hash_sum"), "hash_xor")


_APPLIED = "a AS (SELECT *, ts + (event_id % 40) * INTERVAL 100 MILLISECOND + INTERVAL 500 MILLISECOND AS applied, ((event_id % 40) * 100000 + 500000) / 1e6 AS s FROM events)"
_MINUTES = _APPLIED + ", m AS (SELECT date_trunc('minute', applied) AS minute, count(*) AS n_rows, avg(s) AS avg_s, quantile_cont(s, 0.95) AS p95_s, max(s) AS max_s FROM a GROUP BY 1)"


@query("WITH " + _MINUTES + " SELECT CAST(epoch_us(minute) AS BIGINT) AS minute_us, n_rows, round(avg_s, 6) AS avg_s, round(p95_s, 6) AS p95_s, round(max_s, 6) AS max_s FROM m")
def latency_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency by minute of application."""
    m = latency.by_minute(w.applied_events(spark, sf_dir))
    return m.select(micros("minute").alias("minute_us"), "n_rows", *[F.round(c, 6).alias(c) for c in ("avg_s", "p95_s", "max_s")])


@query("WITH " + _MINUTES + " SELECT CAST(sum(n_rows) AS BIGINT) AS n_rows, round(sum(avg_s * n_rows) / sum(n_rows), 6) AS avg_s, round(max(p95_s), 6) AS p95_s, round(max(max_s), 6) AS max_s, (SELECT round(quantile_cont(s, 0.95), 6) FROM a) AS p95_exact_s FROM m")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency over all minutes."""
    rows = w.applied_events(spark, sf_dir)
    out = latency.summary(latency.by_minute(rows), rows)
    return out.select("n_rows", *[F.round(c, 6).alias(c) for c in ("avg_s", "p95_s", "max_s", "p95_exact_s")])


@query(
    "WITH " + _APPLIED + ", t AS (SELECT 'empty' AS table_name, 0 AS lo, 0 AS hi UNION ALL SELECT 'events', 0, 1) "
    "SELECT 'events' AS table_name, count(*) AS n_rows, floor(avg(s) * 1000) / 1000 AS avg_s FROM a WHERE applied >= TIMESTAMP '2024-01-10' AND applied < TIMESTAMP '2024-01-20' UNION ALL SELECT 'none', CAST(0 AS BIGINT), CAST(NULL AS DOUBLE)"
)
def usage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean latency of a window of time; none where nothing was applied."""
    e = w.applied_events(spark, sf_dir)
    return usage.window_stats({"events": e, "none": e.limit(0)}, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("WITH " + _APPLIED + " SELECT CAST(epoch_us(max(applied)) AS BIGINT) AS last_applied, CAST(epoch_us(max(ts)) AS BIGINT) AS last_commit FROM a")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest application and commit."""
    e = w.applied_events(spark, sf_dir)
    return usage.freshness([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")]).select(micros("last_applied").alias("last_applied"), micros("last_commit").alias("last_commit"))


_LAGS = "l AS (SELECT p AS partition, CASE WHEN p = 3 THEN 0 ELSE greatest(e - p * 10, 0) END AS committed, e AS \"end\" FROM (SELECT user_id % 4 AS p, max(event_id) + 1 AS e FROM events GROUP BY 1))"


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = w.event_log(spark, sf_dir).groupBy("partition").agg((F.max("offset") + 1).alias("end"))
    return usage.partition_lag(ends, ends.where("partition <> 3").select("partition", (F.col("end") - F.col("partition") * 10).alias("committed")))


@query("WITH " + _LAGS + " SELECT CAST(partition AS INTEGER) AS partition, committed, \"end\", greatest(\"end\" - committed, 0) AS lag FROM l")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each partition has not committed."""
    return _lags(spark, sf_dir)


@query("WITH " + _LAGS + " SELECT CAST(sum(greatest(\"end\" - committed, 0)) AS BIGINT) AS backlog FROM l")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all partitions."""
    return usage.backlog(_lags(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.ring(w.table(spark, sf_dir, "events").select(F.col("event_id").alias("at_us"), F.col("event_type").alias("table_name"), F.col("value").alias("duration_ms")), order="at_us")


_RING = "r AS (SELECT event_id AS at_us, event_type AS table_name, value AS duration_ms FROM events ORDER BY event_id DESC LIMIT 512)"


@query("WITH " + _RING + " SELECT * FROM r")
def flush_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 512 flush samples."""
    return _samples(spark, sf_dir)


@query("WITH " + _RING + ", v AS (SELECT count(*) AS n, arg_max(duration_ms, at_us) AS last, list_sort(list(duration_ms)) AS v FROM r) SELECT n AS samples, last AS last_ms, v[CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT) + 1] AS p50_ms, v[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1] AS p95_ms, v[n] AS max_ms FROM v")
def merge_ms_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank figures of the ring."""
    return usage.merge_times(_samples(spark, sf_dir), order="at_us")


@query("SELECT event_id, props AS message FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def error_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest errors of a written error log."""
    return read_errors(spark, w.error_log(spark, sf_dir)).select(F.col("errorDetail").cast("long").alias("event_id"), "message")


_TRIAGE = [(1, 0, 10, 0, 0, 20.0, 20.0, True), (2, 0, 0, 5, 50, 20.0, 21.0, True), (3, 0, 0, 5, 50, 20.0, 2000.0, True), (4, 9, 9, 9, 9, 1.0, 1.0, True), (5, 0, 10, 0, 10, None, None, False)]


@query("SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'reader or source'), (2, 'writer'), (3, 'destination'), (4, 'none'), (5, 'writer unreachable')) AS t(n, bottleneck)")
def bottleneck_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the bottleneck is, from two readings."""
    df = spark.createDataFrame(_TRIAGE, "n int, reader_before long, reader_now long, backlog_before long, backlog_now long, merge_before_ms double, merge_now_ms double, writer_reachable boolean")
    return usage.triage(df).select("n", "bottleneck")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def page_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page, newest first."""
    return control.page(w.table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderdate", *control.page_bounds("25", "50")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def page_by_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by key."""
    return control.page(w.table(spark, sf_dir, "customer"), ["c_custkey"], None, *control.page_bounds("zero", "20")).select("c_custkey", "c_name")


@query("""SELECT (SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation WHERE n_nationkey = 7) AS source, CAST(NULL AS VARCHAR) AS replica""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row on both sides; here the replica lacks it."""
    n = w.table(spark, sf_dir, "nation")
    return control.lookup(n, n.where("n_nationkey <> 7"), "n_nationkey", 7)


_DOCS = (
    "docs AS (SELECT o_orderkey, 'Observation ' || o_orderkey || ' of ' || coalesce(c_name, 'customer ' || o_custkey) || ' at ' || coalesce(n_name, 'nation ' || coalesce(CAST(c_nationkey AS VARCHAR), '')) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ': ' || coalesce(nullif(trim(o_orderpriority), ''), 'no notes') AS text "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey)"
)


@query("WITH " + _DOCS + " SELECT * FROM docs")
def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence a row, with names looked up or a fallback."""
    o, c, n = (w.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    o = documents.looked_up(o, c, "o_custkey", "c_custkey", F.col("c_name"), "who", "customer")
    o = documents.looked_up(o, n.where("n_nationkey % 5 <> 0"), "c_nationkey", "n_nationkey", F.col("n_name"), "place", "nation")
    return o.select("o_orderkey", documents.observation_text(F.col("o_orderkey"), F.col("who"), F.col("place"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")).alias("text"))


@query("WITH " + FOLD + " SELECT user_id FROM folded WHERE op <> 'd' AND NOT (op = 'u' AND still_unchanged = 'props')")
def render_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that need a new document: not those whose embedded column was not sent."""
    f = w.folded_users(w.event_log(spark, sf_dir))
    return documents.to_render(f, {w.USER_STATE: ["props"]}).select("user_id")


DIM = 64


def _vectors(table: str, key: str, p: str = "") -> str:
    """SQL tables, ending with ``e`` (key, slot, x), that give the hashed vectors of a table's texts."""
    return (
        f"{p}w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') AS ws FROM {table}), "
        f"{p}f AS (SELECT {key}, unnest(ws) AS feature, 1.0 AS weight FROM {p}w UNION ALL SELECT {key}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 0.5 FROM {p}w), "
        f"{p}g AS (SELECT {key}, feature, sum(weight) AS weight FROM {p}f GROUP BY ALL), "
        f"{p}h AS (SELECT feature, list_reduce(list_prepend({embed.FNV_OFFSET}::HUGEINT, list_transform(range(0, octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::HUGEINT)), "
        f"lambda a, x: (xor(a, x) * {embed.FNV_PRIME}) % 18446744073709551616) AS h FROM (SELECT DISTINCT feature FROM {p}g)), "
        f"{p}s AS (SELECT {key}, (h % {DIM})::BIGINT AS slot, CAST(sum(CASE WHEN h >= 9223372036854775808 THEN -weight ELSE weight END) AS DOUBLE) AS v FROM {p}g JOIN {p}h USING (feature) GROUP BY ALL), "
        f"{p}n AS (SELECT {key}, sqrt(sum(v * v)) AS size FROM {p}s GROUP BY {key}), "
        f"{p}e AS (SELECT d.{key}, r.range AS slot, CAST(CASE WHEN coalesce(size, 0) = 0 THEN (CASE WHEN r.range = 0 THEN 1 ELSE 0 END) ELSE coalesce(v, 0) / size END AS FLOAT) AS x "
        f"FROM {table} d CROSS JOIN range({DIM}) r LEFT JOIN {p}n ON {p}n.{key} = d.{key} LEFT JOIN {p}s ON {p}s.{key} = d.{key} AND {p}s.slot = r.range)"
    )


@query("WITH " + _vectors("documents", "doc_id") + " SELECT doc_id, string_agg(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT), ',' ORDER BY slot) AS embedding FROM e GROUP BY doc_id")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feature-hashed vectors, written as ten thousandths."""
    rows = w.table(spark, sf_dir, "documents").select("doc_id", embed.hash_embed(F.col("text"), DIM).alias("v"))
    return rows.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x.cast("double") * 10000).cast("long")), ",").alias("embedding"))


@query(
    "SELECT question_id, vec_id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS pos FROM "
    "(SELECT q.vec_id AS question_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE pos <= 5"
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vectors of every twentieth vector, exactly, among all."""
    return _near(spark, sf_dir).select("question_id", F.col("key").alias("vec_id"), "pos", F.round("score", 6).alias("score"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = w.table(spark, sf_dir, "embeddings")
    docs = e.select(F.col("vec_id").alias("key"), "embedding", F.lit(None).cast("timestamp").alias("updated_at"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return nearest(docs, q, retrieve.TOP, own=True)


#: What the change stream leaves of a table with ids: a tenth deleted, a tenth changed.
_LEFT = "SELECT vec_id, CASE WHEN vec_id % 10 = 7 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 10 <> 3"


@query(
    "SELECT question_id, vec_id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS pos FROM "
    "(SELECT q.vec_id AS question_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM (" + _LEFT + ") e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE pos <= 5"
)
def indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in a stored index that then takes up deletes and changes, searched exactly through its cells."""
    e = w.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    index = VectorIndex(Store(spark, w.scratch_folder(spark)), "vectors")
    index.build(e)
    index.apply(e.where("key % 10 = 7").withColumn("embedding", F.transform("embedding", lambda x: -x)), e.where("key % 10 = 3"))
    asked = e.where("key % 20 = 0").select(F.col("key").alias("question_id"), "embedding")
    return index.search(asked, retrieve.TOP).select("question_id", F.col("key").alias("vec_id"), "pos", F.round("score", 6).alias("score"))


_KEYWORDS = (
    "tok AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> ''))) AS term FROM documents), "
    "ask AS (SELECT item_id, unnest(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '')))[1:8]) AS term FROM benchmark), "
    "df AS (SELECT term, count(*) AS df FROM tok WHERE term IN (SELECT term FROM ask) GROUP BY term), "
    "sc AS (SELECT item_id, doc_id, sum(ln(1 + (SELECT count(*) FROM documents) / df)) AS score FROM tok JOIN df USING (term) JOIN ask USING (term) GROUP BY item_id, doc_id), "
    "kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM sc) WHERE pos <= 5)"
)

#: By all words of a question.
_ALL_KEYWORDS = _KEYWORDS.replace("[1:8]", "")


def _words(spark: SparkSession, sf_dir: str, terms: int | None = None) -> tuple[DataFrame, DataFrame]:
    docs = w.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.lit(None).cast("timestamp").alias("updated_at"))
    questions = w.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return retrieve.keyword_top(docs, retrieve.question_terms(questions, terms)), docs


@query("WITH " + _ALL_KEYWORDS + " SELECT item_id AS question_id, doc_id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM kw")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by the rarity of the question's words, all of them, that they hold."""
    hits, _ = _words(spark, sf_dir)
    return hits.select("question_id", F.col("key").alias("doc_id"), "pos", F.round("score", 6).alias("score"))


@query(
    "WITH left_over AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN (SELECT any_value(text) FROM benchmark WHERE item_id = doc_id % 40) || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3), "
    + _KEYWORDS.replace("FROM documents", "FROM left_over") + " SELECT item_id AS question_id, doc_id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM kw"
)
def indexed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a stored keyword index that then takes up deletes and changed texts, asked the benchmark's questions."""
    docs = w.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    asked = w.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    index = KeywordIndex(Store(spark, w.scratch_folder(spark)), "words")
    index.build(docs)
    item = asked.select(F.col("question_id").alias("item"), F.col("text").alias("more")).dropDuplicates(["item"])
    changed = docs.where("key % 10 = 7").withColumn("item", F.col("key") % 40).join(item, "item", "left").select("key", F.concat("more", F.lit(" "), "text").alias("text"))
    index.apply(changed, docs.where("key % 10 = 3"))
    return index.search(asked, terms=retrieve.TERMS).select("question_id", F.col("key").alias("doc_id"), "pos", F.round("score", 6).alias("score"))


@query(
    "WITH " + _KEYWORDS + ", hits AS (SELECT item_id, doc_id, 0 AS source, pos FROM kw UNION ALL SELECT item_id, doc_id, 1, 1 + doc_id % 5 FROM documents, (SELECT item_id FROM benchmark) WHERE doc_id // 5 = item_id), "
    "fst AS (SELECT item_id, doc_id, min(source * 10 + pos) AS at_us FROM hits GROUP BY 1, 2) "
    "SELECT item_id AS question_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY at_us) AS INTEGER) AS rank, CASE WHEN at_us < 10 THEN 'keyword' ELSE 'vector' END AS found_by FROM fst"
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits, then others, each key once; here the others are a stand-in by number."""
    hits, docs = _words(spark, sf_dir, retrieve.TERMS)
    questions = w.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    other = docs.select("key", F.floor(F.col("key") / 5).alias("question_id"), (F.col("key") % 5 + 1).cast("int").alias("pos")).join(questions, "question_id")
    return retrieve.hybrid(hits, other).select("question_id", F.col("key").alias("doc_id"), "rank", "found_by")


@query("SELECT event_id, CAST(greatest(epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts), 0) AS BIGINT) AS stale_us FROM events")
def snapshot_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far copies of each event's time lag behind a fixed time."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return w.table(spark, sf_dir, "events").select("event_id", F.round(retrieve.stale_by(now, F.col("ts").cast("timestamp")) * 1e6).cast("long").alias("stale_us"))


@query("SELECT doc_id, CASE WHEN length(text) > 700 THEN left(text, 700) || '...' ELSE text END AS context FROM documents")
def clip_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to contexts."""
    return w.table(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text")).alias("context"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'seen today, the reed bed.' ELSE 'Ranger log: Ada the blue wildebeest seen resting alone at Old Lake, the reed bed.' END AS note FROM orders")
def place_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's closing place replaced, or the note rewritten."""
    note = F.when(F.col("o_orderkey") % 2 == 0, "seen today, old lake. ").otherwise("unclear")
    place = F.lit("the reed bed")
    otherwise = documents.ranger_log(F.lit("Ada"), F.lit("blue_wildebeest"), F.lit("Old Lake"), place)
    return w.table(spark, sf_dir, "orders").select("o_orderkey", text.place_note(note, place, documents.PLACE_SUFFIX, otherwise).alias("note"))


@query("SELECT id, CASE WHEN id BETWEEN 9000 AND 9099 THEN 'demo' WHEN id >= 3000000000 THEN 'traffic' ELSE 'readonly' END AS scope FROM (SELECT range AS id FROM range(8990, 9110) UNION ALL SELECT range FROM range(2999999990, 3000000010))")
def poke_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be written by id."""
    ids = spark.range(8990, 9110).unionByName(spark.range(2_999_999_990, 3_000_000_010))
    return ids.select("id", control.scope_of(F.col("id")).alias("scope"))


@query(
    "WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, CAST(epoch_us(ts) AS BIGINT) AS \"at\", event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "r AS (SELECT client, \"at\", id, n, TRUE AS accepted, [\"at\"] AS kept FROM e WHERE n = 1 UNION ALL "
    "SELECT e.client, e.\"at\", e.id, e.n, len(list_filter(r.kept, lambda x: x > e.\"at\" - 21600000000)) < 3, "
    "CASE WHEN len(list_filter(r.kept, lambda x: x > e.\"at\" - 21600000000)) < 3 THEN list_append(list_filter(r.kept, lambda x: x > e.\"at\" - 21600000000), e.\"at\") ELSE r.kept END "
    "FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1) SELECT client, \"at\", id, accepted FROM r"
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three accepted events a user in six hours; acceptance is recursive."""
    e = w.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), micros("ts").alias("at"), F.col("event_id").alias("id"))
    return limited(e, 3, 6 * 3_600_000_000)


@query("WITH " + _DOCS + ", q AS (SELECT item_id FROM benchmark) SELECT item_id AS question_id, CASE WHEN text IS NULL THEN 'No matching records.' ELSE 'Closest record: ' || text END AS answer FROM q LEFT JOIN docs ON o_orderkey = item_id AND item_id % 2 = 0")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest record as the answer."""
    questions = w.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    hits = render_documents(spark, sf_dir).where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("question_id"), F.col("text").alias("context"), F.lit(1).alias("rank"))
    return retrieve.extractive_answers(questions, hits)


@query("SELECT user_id, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events QUALIFY nth <= 3")
def last_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last three changes."""
    out = usage.last_rows(w.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos")), "user_id", "pos", 3)
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pos"))).cast("long"))


_WAL = FOLD.replace("AS unsent FROM events)", "AS unsent FROM events WHERE (event_id // 7) % 11 <> 0)")


@query("WITH " + _WAL + ", c AS (SELECT event_id // 7 AS xid, max(event_id) * 2 + 2 AS lsn, arg_max(CAST(epoch_us(ts) AS BIGINT), event_id) AS at_us FROM events GROUP BY 1) SELECT user_id, event_type, value, props, c.at_us, c.lsn FROM folded JOIN c ON c.xid = pos // 7 WHERE op <> 'd'")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw replication messages decoded, stamped with their commits, folded and merged."""
    changes, _ = from_raw(w.raw_events(spark, sf_dir))
    return _users(w.applied(w.no_users(spark), changes))


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that moved to another key keep what was not resent."""
    changes, _ = from_raw(w.raw_moves(spark, sf_dir))
    # read several times
    changes = staged(changes, w.scratch_folder(spark))
    folded = folds.typed(folds.key_columns(folds.fold(ingest.carry_key_changes(changes), sorted(w.ORDER_COLUMNS)), w.ORDER_KEYS), w.ORDER_COLUMNS)
    return merge(empty_replica(spark, w.ORDER_KEYS, w.ORDER_COLUMNS), folded, ["o_orderkey"], sorted(w.ORDER_COLUMNS), F.lit(w.START)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 30000000 ELSE o_orderkey END AS o_orderkey, "
    "CASE WHEN o_orderkey % 50 = 0 THEN '3' WHEN o_orderkey % 50 = 3 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 50 <> 7"
)
def moved_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that moved from key to key, by way of messages, keep what no move has resent."""
    changes, _ = from_raw(w.raw_chains(spark, sf_dir))
    # read several times
    changes = staged(codec.decoded(codec.encoded(changes)).withColumns({"partition": F.lit(0), "offset": F.col("seq")}), w.scratch_folder(spark))
    carried = ingest.carry_key_changes(changes)
    folded = folds.typed(folds.key_columns(folds.fold(carried, sorted(w.ORDER_COLUMNS)), w.ORDER_KEYS), w.ORDER_COLUMNS)
    return merge(empty_replica(spark, w.ORDER_KEYS, w.ORDER_COLUMNS), folded, ["o_orderkey"], sorted(w.ORDER_COLUMNS), F.lit(w.START)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_CUSTOMER = "c_custkey || '|' || CAST(c_acctbal AS DECIMAL(38, 6)) || '|' || c_mktsegment || '|' || c_name || '|' || c_nationkey"
_ORDERS = "o_orderkey || '|' || o_custkey || '|' || CAST(epoch_us(o_orderdate) AS BIGINT) || '|' || o_orderpriority || '|' || o_orderstatus || '|' || CAST(o_totalprice AS DECIMAL(38, 6))"
_CHECKED = (("customer", _CUSTOMER, "c_custkey"), ("orders", _ORDERS, "o_orderkey"))


def _checked(spark: SparkSession, sf_dir: str) -> dict:
    return {n: (w.table(spark, sf_dir, n), [k]) for n, _, k in _CHECKED}


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, * FROM ({_checksum_sql(n, c, k)})" for n, c, k in _CHECKED).replace("AS n,", "AS n_rows,"))
def table_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ordered digests of customers and orders."""
    a, b = (verify.checksum(df, keys).select(F.lit(n).alias("table_name"), "*") for n, (df, keys) in _checked(spark, sf_dir).items())
    return a.unionByName(b)


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT ('0x' || left(md5({c}), 15))::BIGINT AS h FROM {n})" for n, c, _ in _CHECKED))
def additive_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and order-free sums of the rows' hashes, of customers and orders."""
    a, b = (verify.additive_checksum(df, keys).select(F.lit(n).alias("table_name"), "*") for n, (df, keys) in _checked(spark, sf_dir).items())
    return a.unionByName(b)


@query(
    "SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS source_rows, (SELECT count(*) FROM customer) AS replica_rows, TRUE AS matches UNION ALL "
    "SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), FALSE"
)
def verify_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against an equal copy in another order, orders against one with a changed price."""
    tables = _checked(spark, sf_dir)
    (c, ck), (o, ok) = tables["customer"], tables["orders"]
    first = o.agg(F.min("o_orderkey")).first()[0]
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == first, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    out = verify.compare(tables, {"customer": (c.repartition(5), ck), "orders": (changed, ok)})
    return out.select("table_name", "source_rows", "replica_rows", "matches")


@query(
    "WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (event_type = 'view') AS reader, count(*) FILTER (event_type = 'click') AS backlog, quantile_cont(value, 0.5) AS ms FROM events GROUP BY 1), "
    "p AS (SELECT *, lag(reader) OVER (ORDER BY day) AS r0, lag(backlog) OVER (ORDER BY day) AS b0, lag(ms) OVER (ORDER BY day) AS m0 FROM d) "
    "SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN backlog > b0 AND coalesce(ms > 1.2 * m0, FALSE) THEN 'destination' WHEN backlog > b0 THEN 'writer' WHEN reader > r0 THEN 'reader or source' ELSE 'none' END AS bottleneck FROM p WHERE r0 IS NOT NULL"
)
def lag_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the bottleneck was, day by day, from each day's reading and the one before: one row a day."""
    e = w.table(spark, sf_dir, "events").withColumn("day", F.to_date(F.col("ts").cast("timestamp")))
    d = e.groupBy("day").agg(F.count_if(F.col("event_type") == "view").alias("reader_now"), F.count_if(F.col("event_type") == "click").alias("backlog_now"), F.expr("percentile_cont(0.5) within group (order by value)").alias("merge_now_ms"))
    before = d.select(F.date_add("day", 1).alias("day"), *[F.col(f"{c}_now{x}").alias(f"{c}_before{x}") for c, x in (("reader", ""), ("backlog", ""), ("merge", "_ms"))])
    return usage.triage(d.join(before, "day").withColumn("writer_reachable", F.lit(True))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "bottleneck")


def _animals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as animals and nations as watering holes."""
    c = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("animal_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("species"))
    return c, w.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("watering_hole_id"), F.col("n_name").alias("name"))


_LOG = "'Ranger log: ' || c_name || ' the ' || replace(c_mktsegment, '_', ' ') || ' seen resting alone at ' || n_name || ', the shallows.'"


@query(f"SELECT CAST(9001 AS BIGINT) AS observation_id, CAST(c_custkey AS BIGINT) AS animal_id, CAST(n_nationkey AS BIGINT) AS watering_hole_id, {_LOG} AS notes FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1), (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1)")
def demo_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demonstration row in its default shape: first animal, first watering hole."""
    animals, holes = _animals(spark, sf_dir)
    return control.default_row(animals, holes, F.lit(9001).cast("long"), F.lit("the shallows"), F.lit(w.START).cast("timestamp")).drop("observed_at")


@query(f"SELECT o_orderkey AS observation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'seen with calves, the shallows.' ELSE {_LOG} END AS notes FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 30")
def moved_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations moved to another place; notes without a place are written anew from the row's own names, where both are known."""
    animals, holes = _animals(spark, sf_dir)
    k = F.col("o_orderkey")
    rows = w.table(spark, sf_dir, "orders").select(k.alias("observation_id"), F.col("o_custkey").alias("animal_id"), (k % 30).alias("watering_hole_id"), F.when(k % 2 == 0, "seen with calves, old lake. ").otherwise("unclear").alias("notes"))
    return control.moved_rows(rows, animals, holes, F.lit("the shallows")).select("observation_id", "notes")


@query("SELECT (SELECT count(*) FROM orders) AS source, (SELECT count(*) FROM orders WHERE o_orderkey % 97 <> 0) AS replica")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table on both sides, as a page shows them."""
    o = w.table(spark, sf_dir, "orders")
    return spark.createDataFrame([tuple(control.counted(o, o.where("o_orderkey % 97 <> 0")).values())], "source long, replica long")


@query(
    "WITH a AS (SELECT 't' || (range // 5) AS \"table\", range % 5 AS number, 'c' || (range % 5) AS \"column\", range % 7 = 6 AS dropped FROM range(500)), i AS (SELECT 't' || (range // 2) AS \"table\", range % 2 AS number, 1 - range % 2 AS place FROM range(190)) "
    "SELECT \"table\", \"column\", 'text' AS type, place IS NOT NULL AS is_key, place FROM a LEFT JOIN i USING (\"table\", number) WHERE NOT dropped"
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a catalog's tables with their places in the keys."""
    n = F.col("id")
    name = lambda x: F.concat(F.lit("t"), F.floor(x).cast("string")).alias("table")
    attributes = spark.range(500).select(name(n / 5), (n % 5).alias("number"), F.concat(F.lit("c"), n % 5).alias("column"), F.lit("text").alias("type"), (n % 7 == 6).alias("dropped"))
    return registry.catalog_columns(attributes, spark.range(190).select(name(n / 2), (n % 2).alias("number"), (1 - n % 2).alias("place")))


@query("SELECT range AS id, left(repeat(md5(CAST(range AS VARCHAR)), 7), 200) AS payload FROM range(10000)")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filler rows for load."""
    return w.generated(spark, 10_000)


@query(
    "WITH " + _ALL_KEYWORDS + ", " + _vectors("documents", "doc_id", "d_") + ", " + _vectors("benchmark", "item_id", "b_") + ", "
    "dv AS (SELECT doc_id, list(CAST(x AS DOUBLE) ORDER BY slot) AS v FROM d_e GROUP BY doc_id), bv AS (SELECT item_id, list(CAST(x AS DOUBLE) ORDER BY slot) AS v FROM b_e GROUP BY item_id), "
    "near AS (SELECT item_id, doc_id, list_cosine_similarity(dv.v, bv.v) AS score FROM dv, bv), "
    "vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM near) WHERE pos <= 5), "
    "hits AS (SELECT item_id, doc_id, 0 AS source, pos FROM kw UNION ALL SELECT item_id, doc_id, 1, pos FROM vec), "
    "fst AS (SELECT item_id, doc_id, min(source * 10 + pos) AS place FROM hits GROUP BY 1, 2) "
    "SELECT item_id AS question_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY place) AS INTEGER) AS rank, CASE WHEN place < 10 THEN 'keyword' ELSE 'vector' END AS found_by FROM fst"
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector hits of the benchmark's questions, by all their words, over all documents, merged."""
    hits, docs = _words(spark, sf_dir)
    vectors = docs.select("key", embed.hash_embed(F.col("text"), DIM).alias("embedding"), "updated_at")
    asked = w.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), embed.hash_embed(F.col("text"), DIM).alias("embedding"))
    near = nearest(vectors, asked, retrieve.TOP)
    return retrieve.hybrid(hits, near).select("question_id", F.col("key").alias("doc_id"), "rank", "found_by")
