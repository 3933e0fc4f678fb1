"""Integer vectors dealt to blocks of bounded size, and queries that meet every block.

A block is one row of an index table. Where queries meet blocks, each task gets a few blocks and the queries stream past
them, so it holds one block and one batch at a time however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTITIONS, quoted, stage

#: Least and most rows of a block, the latter as components; between them a block has a share of ``SHARES`` of all rows.
ROWS, COMPONENTS, SHARES = 4096, 1 << 23, 1024


def integers(df: DataFrame, id_col: str, vector_col: str, factor: int, more: Sequence = (), name: str = "vectors") -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The rows with a vector to work with, written: ``row``, ``id``, ``more``, ``dim`` and ``q``, ``floor(factor * x)`` of each component x.

    Rows with a null id, or whose vector is null, empty or holds a null or a component that isn't finite, are left out. Also, for each
    length of vectors, how many there are and the largest squared length, rounded up.
    """
    v = F.col(quoted(vector_col)).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(quoted(id_col)).isNotNull()
    held = df.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).cast("long").alias("id"), *more, F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x * factor).cast("long")).alias("q"))
    held = stage(held, name)
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # a row a length
    return held, {r.dim: (r.n, float(r.most)) for r in held.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most")).collect()}


def rows_of(n: int, dim: int, rows: int = ROWS) -> int:
    """How many rows a block should have."""
    most = max(1, COMPONENTS // dim)
    return min(most, max(rows, n // SHARES))


def matrix(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the least type that holds them."""
    most = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def products(v: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows ``a`` of ``v`` and ``b`` of ``u``, exact; ``bound`` is over each of them. Beyond a long they stay at its ends."""
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        v, u = (v.astype(kind), u.astype(kind)) if len(v) < len(a) else (v, u.astype(kind))
        step = 16384
        return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", v[a[i : i + step]].astype(kind, copy=False), u[b[i : i + step]]).astype(np.int64) for i in range(0, len(a), step))])
    whole = [sum(x * y for x, y in zip(v[i].tolist(), u[j].tolist(), strict=True)) for i, j in zip(a, b, strict=True)]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], np.int64)


def meet(index: DataFrame, queries: DataFrame, load: Callable[[dict], object], answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, size: int = 256) -> DataFrame:
    """Each query with each block of its length: ``answer`` gets what ``load`` makes of a block's row and up to ``size`` queries.

    ``index`` has ``dim``, ``number`` (from 0 without gaps) and what ``load`` needs; ``queries`` has ``dim`` and other columns. No order of
    queries is promised.
    """
    places = index.select("dim", "number")
    mine = [c for c in index.columns if c not in ("dim", "number")]
    theirs = [c for c in queries.columns if c != "dim"]
    blank = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    blocks = index.select("number", F.lit(0).alias("kind"), *mine, *blank(queries, theirs))
    asked = queries.join(places, "dim").select("number", F.lit(1).alias("kind"), *blank(index, mine), *theirs)
    count = (places.agg(F.max("number")).first()[0] or 0) + 1
    # a partition a block
    together = blocks.unionByName(asked).repartitionById(min(count, PARTITIONS), F.pmod("number", F.lit(PARTITIONS)).cast("int")).sortWithinPartitions("number", "kind")

    def run(batches):
        block = None
        for batch in batches:
            at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if at[1, a] == 0:
                    block = load({c: batch.column(2 + i)[a].as_py() for i, c in enumerate(mine)})
                    continue
                part = batch.slice(a, b - a).select(list(range(2 + len(mine), batch.num_columns)))
                for start in range(0, part.num_rows, size):
                    yield from answer(block, part.slice(start, size))

    return together.mapInArrow(run, schema)
