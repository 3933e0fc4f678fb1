"""Full-table checksums and their comparison."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import ordered_columns, quoted

NULL = "\\N"


def text_of(df: DataFrame, name: str) -> Column:
    """A value as text that engines agree on; null has a mark of its own."""
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("decimal(38,6)")
    return F.coalesce(c.cast("string"), F.lit(NULL))


def row_text(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[text_of(df, c) for c in ordered_columns(df.columns, keys)])


#: Row hashes that are put in one block.
BLOCK = 512


def checksum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n_rows`` and ``digest``: md5 of the rows' md5s in order of the key's text.

    Rows are sorted by ranges. An md5 is a chain, so one task must read all hashes at last: it gets 16 bytes a row, in
    blocks, and holds a few of these at a time.
    """
    if not keys:
        raise ValueError("a table without a key can't be checked")
    row = F.unhex(F.md5(row_text(df, keys).cast("binary")))
    order = F.concat_ws("|", *[text_of(df, k) for k in sorted(keys)])
    rows = df.select(order.alias("o"), row.alias("m")).repartitionByRange("o").sortWithinPartitions("o", "m")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([n], pa.int64()), pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], ["o", "n", "m"])
                n += 1

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, digest = 0, hashlib.md5()
        for b in batches:
            for m in b.column(0):
                held = m.as_py()
                count += len(held) // 16
                digest.update(held.hex().encode())
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([digest.hexdigest()])], ["n_rows", "digest"])

    # equal keys lie in one range, so a block's first key and its number tell its place
    inorder = rows.mapInArrow(blocks, "o string, n long, m binary").repartition(1).sortWithinPartitions("o", "n").select("m")
    found = inorder.mapInArrow(chained, "n_rows long, digest string").agg(F.coalesce(F.max("n_rows"), F.lit(0)).cast("long").alias("n_rows"), F.max("digest").alias("digest"))
    return found.select("n_rows", F.when(F.col("n_rows") == 0, "").otherwise(F.col("digest")).alias("digest"))


def additive_checksum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n_rows`` and order-free sums of row hashes: partial aggregates, for tables of any size.

    A row's hash is the first 60 bits of its md5, so any engine can repeat the sums.
    """
    h = F.conv(F.substring(F.md5(row_text(df, keys).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(28,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


Table = tuple[DataFrame, Sequence[str]]


def compare(source: Mapping[str, Table], replica: Mapping[str, Table | None], exact: bool = False) -> DataFrame:
    """A row a source table: counts, digests and ``matches``; a replica that can't be read doesn't match.

    With ``exact`` the ordered digest, whose last step is one task; else order-free sums, without one.
    """
    out = None
    for name, (df, keys) in sorted(source.items()):
        sums = lambda d: (checksum(d, keys) if exact else additive_checksum(d, keys).select("n_rows", F.concat_ws(":", "hash_sum", "hash_xor").alias("digest")))  # noqa: B023, E731
        other = replica.get(name)
        right = sums(other[0].select(*[c for c in df.columns if c in other[0].columns])).toDF("replica_rows", "replica_digest") if other else None
        row = sums(df).toDF("source_rows", "source_digest")
        row = row.crossJoin(right) if right is not None else row.select("*", F.lit(None).cast("long").alias("replica_rows"), F.lit(None).cast("string").alias("replica_digest"))
        same = F.coalesce((F.col("source_rows") == F.col("replica_rows")) & (F.col("source_digest") == F.col("replica_digest")), F.lit(False))
        row = row.select(F.lit(name).alias("table_name"), "*", same.alias("matches"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables to compare")
    return out


def all_match(compared: DataFrame) -> DataFrame:
    return compared.agg(F.bool_and("matches").alias("matches"))


def short(digest: str) -> str:
    return digest[:8]


def converge(once: Callable[[], bool], timeout: float, every: float = 2.0) -> bool:
    """Repeat a comparison until it matches or time is up; the last result."""
    until = time.monotonic() + timeout
    while not (done := once()) and time.monotonic() + every <= until:
        time.sleep(every)
    return done
