"""Fold each key's history to its final change.

A column's last token decides its value: a resent value (null among them) is known; a delete and a column that
is neither resent nor unchanged are known to hold nothing to carry; an unchanged column has no
token, so an earlier one shows through. The latest token by log place is an aggregate, with
partial aggregation before the one shuffle, so hot keys shrink where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.codec import canonical
from millrace.schema import quoted


def order_of(changes: DataFrame) -> Column:
    """A change's place in the log."""
    return F.struct(*[F.col(c) for c in ("partition", "offset", "sub") if c in changes.columns])


def fold(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a (table, key): the last op with its place, the columns' folded text values, and ``still_unchanged``.

    ``still_unchanged`` names the columns that the last change left unchanged and for which nothing
    is known since the key's last delete. Values of deletes are null.
    """
    place = order_of(changes)
    keyed = changes.withColumn("pk_key", canonical(F.col("pk"))).withColumn("__place", place)
    live = (F.col("op") != "d") & F.col("after").isNotNull()
    aggregates = [F.max_by(F.struct("op", "lsn", "commit_ts", "pk", "unchanged", *[c for c in ("partition", "offset") if c in changes.columns]), "__place").alias("__last")]
    for i, c in enumerate(columns):
        name = F.lit(c)
        known = live & F.coalesce(F.array_contains(F.map_keys("after"), name), F.lit(False))
        through = live & ~known & F.coalesce(F.array_contains("unchanged", name), F.lit(False))
        token = F.struct(known.alias("known"), F.when(known, F.try_element_at("after", name)).alias("v"))
        aggregates.append(F.max_by(token, F.when(~through, F.col("__place"))).alias(f"__t{i}"))
    folded = keyed.groupBy("table", "pk_key").agg(*aggregates)
    gone = F.col("__last.op") == "d"
    values = [F.when(~gone & F.col(f"__t{i}.known"), F.col(f"__t{i}.v")).alias(c) for i, c in enumerate(columns)]
    open_ = [F.when(~gone & F.coalesce(F.array_contains("__last.unchanged", F.lit(c)), F.lit(False)) & ~F.coalesce(F.col(f"__t{i}.known"), F.lit(False)), F.lit(c)) for i, c in enumerate(columns)]
    still = F.array_compact(F.array(*open_)) if columns else F.array().cast("array<string>")
    rest = [F.col(f"__last.{c}").alias(c) for c in ("pk", "op", "lsn", "commit_ts", *[c for c in ("partition", "offset") if c in changes.columns])]
    return folded.select("table", "pk_key", *rest, *values, still.alias("still_unchanged"))


def key_columns(folded: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Add the key's columns, cast to their Spark types (name -> DDL type)."""
    return folded.select("*", *[F.try_element_at("pk", F.lit(k)).cast(t).alias(k) for k, t in keys.items()])


def typed(folded: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast folded text columns to their Spark types."""
    return folded.withColumns({c: F.col(quoted(c)).cast(t) for c, t in types.items()})


def representative(changes: DataFrame) -> DataFrame:
    """For each table the first change with the most types; its column types are the batch's."""
    rank = F.struct(F.size("types").alias("n"), *[(-F.col(c)).alias(c) for c in ("partition", "offset") if c in changes.columns])
    return changes.groupBy("table").agg(F.max_by(F.struct("op", "types", *[c for c in ("partition", "offset") if c in changes.columns]), rank).alias("r")).select("table", "r.*")
