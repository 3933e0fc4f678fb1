"""Hierarchical checksums: where two copies of a table differ, without comparing them row by row.

Rows are dealt to leaves by a hash of their key, and leaves are grouped by ``FAN`` up to one root, so a node is a prefix of the hash. A node's
digest is the order-free sum and exclusive or of its rows' hashes with their number: a partial aggregate, whatever order or
layout the rows have, and a parent's digest is the sum of its children's. Both sides compute their leaves in one pass each; what moves is a row a leaf. The
comparison starts at the roots and descends only into nodes that differ, and rows are only read of leaves that differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.verify import row_text, text_of
from millrace.schema import quoted

#: Children of a node, levels below the root, and so FAN ** DEPTH leaves.
FAN, DEPTH = 16, 4


def _bits(text: Column) -> Column:
    """The first 60 bits of a text's md5, which any engine can repeat."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[text_of(df, k) for k in sorted(keys)])


def leaf(df: DataFrame, keys: Sequence[str], depth: int = DEPTH) -> Column:
    """A row's leaf: the first bits of its key's hash, so that its ancestors are what is left of shorter prefixes."""
    return F.shiftright(_bits(key_text(df, keys)), 60 - 4 * depth)


def leaves(df: DataFrame, keys: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(node, n, hash_sum, hash_xor): a row a leaf that holds rows."""
    if not keys:
        raise ValueError("a table without a key can't be checked")
    rows = df.select(leaf(df, keys, depth).alias("node"), _bits(row_text(df, keys)).alias("h"))
    return rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above."""
    up = F.shiftright("node", 4).alias("node")
    return nodes.groupBy(up).agg(F.sum("n").alias("n"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor"))


def tree(df: DataFrame, keys: Sequence[str], depth: int = DEPTH) -> list[DataFrame]:
    """Levels of digests, the root first. The leaves are computed once."""
    levels = [leaves(df, keys, depth).persist()]
    for _ in range(depth):
        levels.insert(0, parents(levels[0]))
    return levels


def differing(source: list[DataFrame], replica: list[DataFrame]) -> list[int]:
    """The leaves that differ, found from the root down: at each level only children of nodes that differ are compared.

    What is collected at a level is no more than ``FAN`` times what differed above it.
    """
    found = [0]
    for n, (s, r) in enumerate(zip(source, replica, strict=True)):
        if n:
            able = F.shiftright("node", 4).isin(found)
            s, r = s.where(able), r.where(able)
        both = s.alias("s").join(r.alias("r"), F.col("s.node") == F.col("r.node"), "full_outer")
        same = F.lit(True)
        for c in ("n", "hash_sum", "hash_xor"):
            same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
        found = sorted(x[0] for x in both.where(~same).select(F.coalesce("s.node", "r.node")).collect())
        if not found:
            return []
    return found


def differences(source: DataFrame, replica: DataFrame, keys: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(keys, difference): the rows that are ``missing`` in the replica, ``extra`` there, or ``changed``; none where the roots agree.

    Rows with null keys count by their text like any others. Rows with one key are compared as a whole: by their number and hashes.
    """
    replica = replica.select(*[quoted(c) for c in source.columns])
    trees = tree(source, keys, depth), tree(replica, keys, depth)
    try:
        nodes = differing(*trees)
    finally:
        for t in trees:
            t[-1].unpersist()

    def side(df: DataFrame) -> DataFrame:
        rows = df.where(leaf(df, keys, depth).isin(nodes)) if nodes else df.limit(0)
        hashed = rows.select(*[quoted(k) for k in keys], key_text(rows, keys).alias("__key"), _bits(row_text(rows, keys)).alias("__h"))
        return hashed.groupBy("__key", *[quoted(k) for k in keys]).agg(F.count("*").alias("n"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("h"))

    s, r = side(source), side(replica)
    both = s.alias("s").join(r.alias("r"), F.col("s.__key") == F.col("r.__key"), "full_outer")
    what = F.when(F.col("r.__key").isNull(), "missing").when(F.col("s.__key").isNull(), "extra").when(~(F.col("s.h").eqNullSafe(F.col("r.h")) & (F.col("s.n") == F.col("r.n"))), "changed")
    names = [F.coalesce(F.col(f"s.{quoted(k)}"), F.col(f"r.{quoted(k)}")).alias(k) for k in keys]
    return both.select(*names, what.alias("difference")).where("difference is not null")
