"""From raw replication messages to change rows.

Raw messages carry the positional values of a row and name its relation by number; relations are a
small dimension with ordered columns. All checks are columns, so bad rows can be set apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.codec import canonical
from millrace.operators.scratch import checkpointed
from millrace.schema import SNAPSHOT, source_type, type_name

#: relation(relation_id, table, columns array<struct<name, oid, is_key>>)
#: tuple(xid, seq, action insert/update/delete, relation_id, values array<struct<kind, text>>, old array<...>)
#: kind: t text, n null, u unchanged
#: raw messages: see ``sources.wal``
ACTIONS = {"I": "insert", "U": "update", "D": "delete"}


def _entries(columns: Column, values: Column, keep) -> Column:
    zipped = F.arrays_zip(columns.alias("c"), values.alias("v"))
    return F.map_from_entries(F.transform(F.filter(zipped, keep), lambda z: F.struct(z["c"]["name"], z["v"]["text"])))


def decode_tuples(tuples: DataFrame, relations: DataFrame) -> DataFrame:
    """Join tuples with their relations and build op, pk, after, unchanged, types, old_pk and error. Other actions are skipped."""
    return _decoded(tuples.where(F.col("action").isin(*ACTIONS.values())).join(relations, "relation_id", "left"))


def _decoded(joined: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    cols, vals, old = F.col("columns"), F.col("values"), F.col("old")
    delete = F.col("action") == "delete"
    shown = F.when(delete, old).otherwise(vals)
    keyed = lambda z: z["c"]["is_key"]
    pk = _entries(cols, shown, keyed)
    error = (
        F.when(cols.isNull(), "unknown relation")
        .when(~F.exists(cols, lambda c: c["is_key"]), "no key")
        .when(shown.isNull(), "no row")
        .when(F.size(shown) != F.size(cols), "wrong number of values")
        .when((F.col("action") == "insert") & F.exists(vals, lambda v: v["kind"] == "u"), "unchanged value in an insert")
    )
    zipped = F.arrays_zip(cols.alias("c"), vals.alias("v"))
    unchanged = F.transform(F.filter(zipped, lambda z: z["v"]["kind"] == "u"), lambda z: z["c"]["name"])
    types = F.map_from_entries(F.transform(cols, lambda c: F.struct(c["name"], type_name(c["oid"]))))
    fine = error.isNull()
    old_pk = F.when(fine & (F.col("action") == "update") & old.isNotNull(), _entries(cols, old, keyed))
    return joined.select(
        *[c for c in ("xid", "seq") if c in joined.columns],
        F.when(F.col("action") == "insert", "c").when(F.col("action") == "update", "u").when(delete, "d").alias("op"),
        "table",
        F.when(fine, pk).alias("pk"),
        F.when(fine & ~delete, _entries(cols, vals, lambda z: ~z["c"]["is_key"] & (z["v"]["kind"] != "u"))).alias("after"),
        F.when(fine & ~delete, unchanged).alias("unchanged"),
        F.when(fine, types).alias("types"),
        old_pk.alias("old_pk"),
        error.alias("error"),
        *more,
    )


def split_key_changes(changes: DataFrame) -> DataFrame:
    """An update that changes the key becomes a delete of the old and a create of the new row.

    ``sub`` orders the two. The create remembers the old key in ``prev_pk``, so that values that were not
    resent can be taken from the old row.
    """
    moved = (F.col("op") == "u") & F.col("old_pk").isNotNull() & (F.to_json("old_pk") != F.to_json("pk"))
    named = [c for c in changes.columns if c not in ("op", "pk", "after", "unchanged", "old_pk")]
    null_map, null_list = F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>")

    def event(op, pk, after, unchanged, prev, sub):
        return F.struct(op.alias("op"), pk.alias("pk"), after.alias("after"), unchanged.alias("unchanged"), prev.alias("prev_pk"), F.lit(sub).alias("sub"))

    same = F.array(event(F.col("op"), F.col("pk"), F.col("after"), F.col("unchanged"), null_map, 0))
    both = F.array(event(F.lit("d"), F.col("old_pk"), null_map, null_list, null_map, 0), event(F.lit("c"), F.col("pk"), F.col("after"), F.col("unchanged"), F.col("old_pk"), 1))
    return changes.select(*named, F.explode(F.when(moved, both).otherwise(same)).alias("e")).select(*named, "e.*")


def values_of(rows: DataFrame, table: str, keys: list[str], columns: list[str]) -> DataFrame:
    """A replica's rows as (table, k, after): their key as canonical text and their other values as text."""
    text = lambda cols: F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]) if cols else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(table).alias("table"), canonical(text(sorted(keys))).alias("k"), text(columns).alias("after"))


def _sources(changes: DataFrame, moves: DataFrame, replica: DataFrame | None) -> DataFrame:
    """For each unsent column of each move, what its old key's history says last before it: a value, or the move that brought the row there.

    Rows (table, at, c, known, v, via): ``via`` is the place of an earlier move, ``at`` of this one. The histories are walked in
    windows, so a key costs its length, however often its row has moved.
    """
    keyed = changes.select("table", canonical(F.col("pk")).alias("k"), "at", "op", "after", "unchanged", "prev_pk").join(moves.select("table", "k").distinct(), ["table", "k"], "left_semi")
    # read several times, and only the histories of rows that moved
    keyed = checkpointed(keyed)
    none = lambda kind: F.lit(None).cast(kind)
    said = keyed.where("after is not null").select("table", "k", "at", F.explode("after").alias("c", "v")).select("table", "k", "at", "c", F.struct(F.lit(True).alias("known"), "v", none("long").alias("via")).alias("token"))
    brought = keyed.where("prev_pk is not null").select("table", "k", "at", F.explode("unchanged").alias("c"), F.struct(F.lit(False).alias("known"), none("string").alias("v"), F.col("at").alias("via")).alias("token"))
    tokens = said.unionByName(brought)
    if replica is not None:
        held = replica.join(moves.select("table", "k").distinct(), ["table", "k"], "left_semi").select("table", "k", F.lit(-1).cast("long").alias("at"), F.explode("after").alias("c", "v"))
        tokens = tokens.unionByName(held.select("table", "k", "at", "c", F.struct(F.lit(True).alias("known"), "v", none("long").alias("via")).alias("token")))
    asked = moves.select("table", "k", "at", F.explode("unchanged").alias("c"), none(tokens.schema["token"].dataType.simpleString()).alias("token"), F.lit(True).alias("asks"))
    # a token at a move's own place is of the row that it makes, not of the one that it leaves
    w = Window.partitionBy("table", "k", "c").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    placed = F.when(F.col("token").isNotNull(), F.struct("at", "token"))
    last = tokens.withColumn("asks", F.lit(False)).unionByName(asked).withColumn("said", F.last(placed, ignorenulls=True).over(w)).where("asks")
    # what was said before the row was last deleted is gone
    gone = keyed.where("op = 'd'").select("table", "k", "at", F.col("at").alias("gone"), F.lit(None).cast("string").alias("c"), none(last.schema["said"].dataType.simpleString()).alias("said"))
    w = Window.partitionBy("table", "k").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    both = last.select("table", "k", "at", none("long").alias("gone"), "c", "said").unionByName(gone)
    both = both.withColumn("gone", F.last("gone", ignorenulls=True).over(w)).where("c is not null")
    live = F.col("said").isNotNull() & (F.col("gone").isNull() | (F.col("said.at") > F.col("gone")))
    return both.select("table", "at", "c", F.coalesce(live & F.col("said.token.known"), F.lit(False)).alias("known"), F.when(live, F.col("said.token.v")).alias("v"), F.when(live, F.col("said.token.via")).alias("via"))


def carry_key_changes(changes: DataFrame, replica: DataFrame | None = None) -> DataFrame:
    """Fill what a moved row did not resend from the row as it was before the move.

    Needs ``prev_pk``, and ``seq`` or ``offset`` as place in the source's log. An unsent column's value is what the old key's history within these
    changes says last, or the replica as it was before them (see ``values_of``). Where that row has itself come from another key with the
    column unsent, its move is asked in turn: such chains are shortened by pointer doubling, so a chain of n moves takes about log2(n) joins of the moves with
    themselves. What is not found stays unchanged. Both halves of a move must be among these changes.
    """
    at = F.coalesce(*[F.col(c) for c in ("seq", "offset") if c in changes.columns])
    changes = changes.withColumn("at", at)
    moves = changes.where("prev_pk is not null and size(unchanged) > 0").select("table", "at", canonical(F.col("prev_pk")).alias("k"), "unchanged")
    if moves.isEmpty():
        return changes.drop("at")
    found = checkpointed(_sources(changes, moves, replica))
    while not found.where("via is not null").isEmpty():
        target = found.select("table", "c", F.col("at").alias("via"), F.struct("known", "v", F.col("via").alias("next")).alias("t"))
        ahead = found.where("via is not null").select("table", "at", "c", "via").join(target, ["table", "c", "via"], "left")
        done = found.where("via is null")
        found = checkpointed(done.unionByName(ahead.select("table", "at", "c", F.coalesce("t.known", F.lit(False)).alias("known"), F.col("t.v").alias("v"), F.col("t.next").alias("via"))))
    carried = found.where("known").groupBy("table", "at").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("carried"))
    # both halves of a move have one place; only the new row is filled, and only such rows are joined
    lacks = F.coalesce(F.col("prev_pk").isNotNull() & (F.size("unchanged") > 0), F.lit(False))
    out, use = changes.where(lacks).join(carried, ["table", "at"], "left"), F.col("carried").isNotNull()
    filled = out.withColumn("after", F.when(use, F.map_concat("after", "carried")).otherwise(F.col("after")))
    filled = filled.withColumn("unchanged", F.when(use, F.array_except("unchanged", F.map_keys("carried"))).otherwise(F.col("unchanged")))
    return changes.where(~lacks).unionByName(filled.select(*changes.columns)).drop("at")


def stamp_commits(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Give a transaction's changes its commit's LSN and time; those of open transactions vanish."""
    return changes.drop("lsn", "commit_ts").join(commits.select("xid", "lsn", "commit_ts"), "xid")


def relation_versions(raw: DataFrame) -> DataFrame:
    """Relations with the part of the log, from one LSN to before the next, that each description holds for."""
    w = Window.partitionBy("relation_id").orderBy("lsn")
    first = F.when(F.row_number().over(w) > 1, F.col("lsn")).otherwise(F.lit(0))
    return raw.where("kind = 'R'").select("relation_id", "relation.*", first.alias("since"), F.coalesce(F.lead("lsn").over(w), F.lit((1 << 63) - 1)).alias("before"))


def assembled(raw: DataFrame) -> DataFrame:
    """Raw messages as change rows, with ``error`` where a row can't be decoded.

    Rows of a transaction carry its commit's LSN and time; those without a commit vanish, as do messages of no use here. A
    row's own place in the log is its ``offset``, and an update that changes a key becomes a delete and a create. Rows that have come through
    ``streaming.transactions`` have ``commit_lsn`` and their relation already.
    """
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    tuples = raw.where(F.col("kind").isin(*ACTIONS)).withColumnsRenamed({"lsn": "seq"}).withColumn("action", action[F.col("kind")])
    if "commit_lsn" in raw.columns:
        named = tuples.select("xid", "seq", "action", "relation.*", "values", "old", F.col("commit_lsn").alias("lsn"), "commit_ts")
        rows = _decoded(named, ["lsn", "commit_ts"])
    else:
        commits = raw.where("kind = 'C'").select("xid", "lsn", "commit_ts")
        versions = relation_versions(raw).withColumnRenamed("relation_id", "r")
        plain = tuples.select("xid", "seq", "action", "relation_id", "values", "old")
        # a small dimension; by its number all rows of a relation would meet in one task
        named = plain.join(F.broadcast(versions), (F.col("relation_id") == F.col("r")) & (F.col("seq") >= F.col("since")) & (F.col("seq") < F.col("before")), "left")
        rows = stamp_commits(_decoded(named), commits)
    return split_key_changes(rows).withColumnRenamed("seq", "offset").withColumn("partition", F.lit(0)).drop("xid")


def snapshot_events(rows: DataFrame, table: str, keys: list[str], start, types: dict[str, str] | None = None) -> DataFrame:
    """A table's rows as snapshot events: lsn 0, one commit time, values as text, types by the source's names."""
    if not keys:
        raise ValueError(f"{table} has no key")
    text = lambda cols: F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]) if cols else F.create_map().cast("map<string,string>")
    types = types or {f.name: source_type(f.dataType) for f in rows.schema}
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(
        F.lit(SNAPSHOT).alias("op"),
        F.lit(table).alias("table"),
        F.lit(0).cast("long").alias("lsn"),
        F.lit(start).cast("timestamp").alias("commit_ts"),
        text(sorted(keys)).alias("pk"),
        text(rest).alias("after"),
        F.array().cast("array<string>").alias("unchanged"),
        F.create_map(*[F.lit(x) for kv in sorted(types.items()) for x in kv]).alias("types"),
    )
