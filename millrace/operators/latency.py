"""Commit-to-apply latency of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.merge import APPLY_TS, COMMIT_TS


def seconds(applied: Column, committed: Column) -> Column:
    return (F.unix_micros(applied.cast("timestamp")) - F.unix_micros(committed.cast("timestamp"))) / 1e6


def _timed(replica: DataFrame, since=None) -> DataFrame:
    rows = replica.where(F.col(COMMIT_TS).isNotNull() & F.col(APPLY_TS).isNotNull())
    if since is not None:
        rows = rows.where(F.col(APPLY_TS) >= F.lit(since).cast("timestamp"))
    return rows.select(F.col(APPLY_TS).cast("timestamp").alias("applied"), seconds(F.col(APPLY_TS), F.col(COMMIT_TS)).alias("s"))


def by_minute(replica: DataFrame, since=None) -> DataFrame:
    """Per minute of application: rows, mean, interpolated 95th percentile and maximum of seconds."""
    return (
        _timed(replica, since)
        .groupBy(F.date_trunc("minute", "applied").alias("minute"))
        .agg(F.count("*").alias("n_rows"), F.avg("s").alias("avg_s"), F.expr("percentile_cont(0.95) within group (order by s)").alias("p95_s"), F.max("s").alias("max_s"))
    )


def summary(buckets: DataFrame, replica: DataFrame | None = None) -> DataFrame:
    """Over all minutes: rows, row-weighted mean, ``p95_s`` as the largest of the minutes', maximum.

    With the replica, also ``p95_exact_s`` over its rows.
    """
    out = buckets.agg(F.sum("n_rows").alias("n_rows"), (F.sum(F.col("avg_s") * F.col("n_rows")) / F.sum("n_rows")).alias("avg_s"), F.max("p95_s").alias("p95_s"), F.max("max_s").alias("max_s"))
    if replica is not None:
        out = out.crossJoin(_timed(replica).agg(F.expr("percentile_cont(0.95) within group (order by s)").alias("p95_exact_s")))
    return out


def report(replica: DataFrame, since=None) -> str:
    """One line; raises where nothing was applied."""
    r = summary(by_minute(replica, since)).first()
    if not r.n_rows:
        raise ValueError("no rows with both times")
    return f"{r.n_rows} rows, avg {r.avg_s:.1f} s / p95 {r.p95_s:.0f} s / max {r.max_s:.0f} s"


def write_csv(buckets: DataFrame, path: str) -> None:
    """Minutes in order, seconds with three digits. A bucket a minute: small."""
    digits = [F.format_string("%.3f", c).alias(c) for c in ("avg_s", "p95_s", "max_s")]
    buckets.orderBy("minute").select(F.date_format("minute", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("minute"), "n_rows", *digits).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
