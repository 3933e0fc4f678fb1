"""Merge folded changes into keyed replica tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schema import quoted

COMMIT_TS, APPLY_TS, LSN = "_commit_ts", "_apply_ts", "_lsn"
META = (COMMIT_TS, APPLY_TS, LSN)


def merge(target: DataFrame, folded: DataFrame, keys: Sequence[str], columns: Sequence[str], apply_ts: Column, guard: bool = True) -> DataFrame:
    """The target after the changes.

    A delete removes its row and one without a row is ignored; other changes insert or update, with
    ``still_unchanged`` columns keeping the target's value. With ``guard`` a change whose LSN is
    below the row's is old and leaves it as it is; a snapshot row (LSN 0) so only replaces snapshot rows. Keys join null-safe; both sides shuffle on them once.
    """
    t, s = target.alias("t"), folded.alias("s")
    match = None
    for k in keys:
        same = F.col(f"t.{quoted(k)}").eqNullSafe(F.col(f"s.{quoted(k)}"))
        match = same if match is None else match & same
    joined = t.withColumn("__t", F.lit(True)).alias("t").join(s, match, "full_outer")
    has_t, has_s = F.col("t.__t").isNotNull(), F.col("s.op").isNotNull()
    old = has_t & has_s & (F.col("s.lsn") < F.coalesce(F.col(f"t.{LSN}"), F.lit(0))) if guard else F.lit(False)
    use = has_s & ~old
    kept = joined.where((use & (F.col("s.op") != "d")) | (~use & has_t))
    key = [F.coalesce(F.col(f"t.{quoted(k)}"), F.col(f"s.{quoted(k)}")).alias(k) for k in keys]
    value = [F.when(use & ~F.coalesce(F.array_contains("s.still_unchanged", F.lit(c)), F.lit(False)), F.col(f"s.{quoted(c)}")).otherwise(F.col(f"t.{quoted(c)}")).alias(c) for c in columns]
    meta = [
        F.when(use, F.col("s.commit_ts")).otherwise(F.col(f"t.{COMMIT_TS}")).alias(COMMIT_TS),
        F.when(use, apply_ts.cast("timestamp")).otherwise(F.col(f"t.{APPLY_TS}")).alias(APPLY_TS),
        F.when(use, F.greatest(F.col("s.lsn"), F.coalesce(F.col(f"t.{LSN}"), F.lit(0)))).otherwise(F.col(f"t.{LSN}")).alias(LSN),
    ]
    return kept.select(*key, *value, *meta)


def empty_replica(spark, keys: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """A replica without rows: key columns, then the others, then the metadata."""
    ddl = ", ".join(f"{quoted(c)} {t}" for c, t in {**keys, **columns}.items())
    return spark.createDataFrame([], f"{ddl}, {COMMIT_TS} timestamp, {APPLY_TS} timestamp, {LSN} long")


def evolve(target: DataFrame, folded_types: dict[str, str]) -> DataFrame:
    """Add columns that a change has and the replica lacks, as nulls, before the metadata."""
    new = {c: t for c, t in folded_types.items() if c not in target.columns}
    body = [c for c in target.columns if c not in META]
    return target.select(*map(quoted, body), *[F.lit(None).cast(t).alias(c) for c, t in sorted(new.items())], *META)


def upsert(target: DataFrame, rows: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows replace those of the same keys; then the keys of ``deletes`` go. For derived tables."""
    keys = list(keys)
    untouched = target.join(rows.select(*keys), keys, "left_anti")
    return untouched.unionByName(rows).join(deletes.select(*keys), keys, "left_anti")


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose keys the target lacks."""
    return target.unionByName(rows.join(target.select(*keys), list(keys), "left_anti"))


def reset_or_insert(target: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Insert rows, or reset those that exist except for the columns ``keep``, which stay as they were."""
    keys = list(keys)
    held = target.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep], F.lit(True).alias("__held"))
    fresh = rows.join(held, keys, "left")
    cols = [F.when(F.col("__held"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in target.columns]
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(fresh.select(*cols))
