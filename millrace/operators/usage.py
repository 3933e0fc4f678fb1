"""Usage, freshness, backlog and merge-time figures, and triage."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.latency import seconds
from millrace.operators.merge import APPLY_TS, COMMIT_TS

RING = 512


def parse_window(start: str | None = None, end: str | None = None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """RFC 3339 bounds; by default the hour up to now."""
    def at(text: str, name: str) -> datetime:
        try:
            found = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError as e:
            raise ValueError(f"{name} must be an RFC 3339 time") from e
        if found.tzinfo is None:
            raise ValueError(f"{name} must have a zone")
        return found.astimezone(UTC)

    to = at(end, "to") if end else (now or datetime.now(UTC))
    since = at(start, "from") if start else to - timedelta(hours=1)
    if to <= since:
        raise ValueError("to must be after from")
    return since, to


def truncated_ms(s: Column) -> Column:
    """Seconds cut, not rounded, to whole milliseconds."""
    ms = s * 1000
    return F.when(ms < 0, F.ceil(ms)).otherwise(F.floor(ms)) / 1000


def window_stats(replicas: Mapping[str, DataFrame], since, to) -> DataFrame:
    """Per table the rows applied in [since, to) and their mean latency; null where there are none."""
    out = None
    for name, df in sorted(replicas.items()):
        applied = F.col(APPLY_TS).cast("timestamp")
        rows = df.where((applied >= F.lit(since).cast("timestamp")) & (applied < F.lit(to).cast("timestamp")) & F.col(COMMIT_TS).isNotNull())
        row = rows.agg(F.count("*").alias("n_rows"), truncated_ms(F.avg(seconds(F.col(APPLY_TS), F.col(COMMIT_TS)))).alias("avg_s")).select(F.lit(name).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def freshness(replicas: list[DataFrame]) -> DataFrame:
    """The newest application and commit over all tables."""
    out = None
    for df in replicas:
        row = df.select(F.col(APPLY_TS).cast("timestamp").alias("a"), F.col(COMMIT_TS).cast("timestamp").alias("c"))
        out = row if out is None else out.unionByName(row)
    return out.agg(F.max("a").alias("last_applied"), F.max("c").alias("last_commit"))


def partition_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition committed and end offset and what lies between; nothing committed counts from 0."""
    c = F.greatest(F.coalesce("committed", F.lit(0)), F.lit(0))
    return ends.join(committed, "partition", "left").select("partition", c.alias("committed"), "end", F.greatest(F.col("end") - c, F.lit(0)).alias("lag"))


def backlog(lags: DataFrame) -> DataFrame:
    return lags.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("backlog"))


def ring(flushes: DataFrame, size: int = RING, order: str = "at") -> DataFrame:
    """The last ``size`` flush samples."""
    return flushes.orderBy(F.desc(order)).limit(size)


def nearest_rank(sorted_values: Column, p: float) -> Column:
    n = F.size(sorted_values)
    return F.when(n > 0, F.try_element_at(sorted_values, (F.floor(p * (n - 1) + 0.5) + 1).cast("int")))


def merge_times(samples: DataFrame, value: str = "duration_ms", order: str = "at") -> DataFrame:
    """Number of samples, last, nearest-rank median and 95th percentile, and maximum. Takes a ring: bounded."""
    out = samples.agg(F.count("*").alias("samples"), F.max_by(value, order).alias("last_ms"), F.sort_array(F.collect_list(value)).alias("v"), F.max(value).alias("max_ms"))
    zero = F.lit(0.0)
    return out.select("samples", F.coalesce("last_ms", zero).alias("last_ms"), F.coalesce(nearest_rank(F.col("v"), 0.5), zero).alias("p50_ms"), F.coalesce(nearest_rank(F.col("v"), 0.95), zero).alias("p95_ms"), F.coalesce("max_ms", zero).alias("max_ms"))


def triage(samples: DataFrame, rise: float = 1.2) -> DataFrame:
    """Where the bottleneck is, from two readings of source lag, backlog and merge time.

    Columns: reader_before, reader_now, backlog_before, backlog_now, merge_before_ms, merge_now_ms,
    writer_reachable. A merge time rises if it grows to over ``rise`` times what it was.
    """
    reader = F.col("reader_now") > F.col("reader_before")
    queue = F.col("backlog_now") > F.col("backlog_before")
    slower = F.coalesce(F.col("merge_now_ms") > rise * F.col("merge_before_ms"), F.lit(False))
    return samples.withColumn(
        "bottleneck",
        F.when(~F.col("writer_reachable"), "writer unreachable")
        .when(queue & slower, "destination")
        .when(queue, "writer")
        .when(reader, "reader or source")
        .otherwise("none"),
    )


def last_rows(df: DataFrame, partition: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
