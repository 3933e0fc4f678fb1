"""Exact top-k inner products by an impact-ordered index.

Vectors of integers are dealt to blocks. A block's index holds posting segments: for each impact, the magnitude of a component quantised
to ``LEVELS`` steps down from the block's largest, two a halving, and each component, the members that have such a value there. Queries in batches are answered a score at
a time: segments in descending order of impact add their products to the members' running scores.

After an impact is done, what is left of a member is a vector of small components whose length is known, so a running score is off by no more than
that length times the query's. A member is possible while its upper bound reaches the k-th highest lower bound of the block. The
work on a query only stops once the possible members, which hold the true top k by this proof, cost less to score anew than the segments
that are left; otherwise all segments are taken. Then the possible members are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import integers, matrix, meet, narrow, products, rows_of
from .common import stage

FACTOR, EVERY, K, LEVELS = 64, 20, 20, 16
#: Queries scored at a time: their running scores stay in a core's cache.
BATCH = 64
#: Just within a long.
END = 9.22e18
INDEX = "dim int, number int, width int, ids binary, rows binary, vectors binary, members binary, edges binary, rests binary"
FOUND = "query_row long, query_id long, vec_id long, vec_row long, score long"


def segments(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of all segments side by side, highest impact first, where each segment starts, and what each impact leaves.

    The last is a row an impact: the length of each member's part below it. Zeros are in no segment.
    """
    n, dim = v.shape
    size = np.abs(v.astype(float))
    # two steps a halving of the largest
    steps = 2 * np.log2(max(size.max(initial=0.0), 1.0) / np.maximum(size, 1.0))
    level = levels - 1 - np.minimum(levels - 1, steps.astype(int))
    member, part = np.nonzero(v)
    place = (levels - 1 - level[member, part]) * dim + part
    by = np.argsort(place, kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=levels * dim))))
    rests = np.array([np.sqrt((np.where(level < step, size, 0.0) ** 2).sum(1)) for step in reversed(range(levels))])
    # rounded up, so that bounds stay bounds
    return member[by].astype("<u4"), edges.astype("<i8"), np.nextafter(rests.astype("<f4"), np.float32(np.inf)) * np.float32(1.000001)


class Block:
    """A block's posting segments and members."""

    def __init__(self, row: dict):
        dim = row["dim_"]
        self.ids, self.rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
        self.v = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dim)
        self.members, self.edges = np.frombuffer(row["members"], "<u4").astype(np.intp), np.frombuffer(row["edges"], "<i8")
        part = np.repeat(np.arange(len(self.edges) - 1) % dim, np.diff(self.edges))
        self.worth = self.v[self.members, part].astype(np.float64)
        self.rests = np.frombuffer(row["rests"], "<f4").reshape(-1, len(self.v))
        self.place = {r: i for i, r in enumerate(self.rows.tolist())}
        self.norm = float(np.sqrt((self.v.astype(float) ** 2).sum(1)).max(initial=0.0))

    def best(self, u: np.ndarray, own: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query, member and score of each query's ``k`` best (ties to the smaller id), and how many postings were left out.

        ``own`` are the queries' own rows, which don't count.
        """
        n, m, dim = len(self.v), len(u), u.shape[1]
        lengths = np.sqrt((u.astype(float) ** 2).sum(1))
        bound = self.norm * float(lengths.max(initial=0.0)) + 1
        kind = np.float32 if bound < 1 << 24 else np.float64
        lengths = (lengths * 1.000001).astype(kind)
        # beyond exact doubles, running scores are off by their rounding too
        slack = 0.0 if bound < 1 << 53 else bound * 1e-13 * dim
        sums, asked = np.zeros((n, m), kind), np.ascontiguousarray(u.T, kind)
        for q, row in enumerate(own):
            if row in self.place:
                sums[self.place[row], q] = -np.inf
        members, queries, open_, skipped = [], [], np.arange(m), 0
        worth = self.worth.astype(kind)
        held, more = (np.empty((int(np.diff(self.edges).max(initial=0)), m), kind) for _ in range(2))
        for step, rest in enumerate(self.rests):
            for part in range(dim):
                a, b = self.edges[step * dim + part : step * dim + part + 2]
                if a < b:
                    some = self.members[a:b]
                    now = np.take(sums, some, axis=0, out=held[: b - a], mode="clip")
                    now += np.multiply(worth[a:b, None], asked[part], out=more[: b - a])
                    sums[some] = now
            left = len(self.members) - int(self.edges[(step + 1) * dim])
            if left:
                # the bounds cost as much as a few segments: a few queries tell whether they are worth it
                few = np.arange(0, len(open_), 8)
                _, query = self._possible(sums[:, few], rest, lengths[open_[few]], slack, k)
                if (np.bincount(query, minlength=len(few)) * dim > left).all():
                    continue
            member, query = self._possible(sums, rest, lengths[open_], slack, k)
            # scoring a possible member takes its components, a segment's member one
            done = np.bincount(query, minlength=len(open_)) * dim <= left if left else np.ones(len(open_), bool)
            members.append(member[done[query]])
            queries.append(open_[query[done[query]]])
            skipped += left * int(done.sum())
            if done.all():
                break
            if done.any():
                open_, sums, asked = open_[~done], np.ascontiguousarray(sums[:, ~done]), np.ascontiguousarray(asked[:, ~done])
                held, more = (np.empty((len(held), len(open_)), kind) for _ in range(2))
        member, query = np.concatenate(members), np.concatenate(queries)
        score = products(self.v, u, member, query, bound)
        by = np.lexsort((self.ids[member], -score.astype(float) if bound >= 1 << 53 else -score, query))
        query, member, score = query[by], member[by], score[by]
        if bound >= 1 << 53:
            # doubles can't tell such scores apart
            by = np.array(sorted(range(len(query)), key=lambda i: (query[i], -int(score[i]), self.ids[member[i]])), int)
            query, member, score = query[by], member[by], score[by]
        first = np.searchsorted(query, np.arange(m))
        kept = np.arange(len(query)) - first[query] < k
        return query[kept], member[kept], score[kept], skipped

    def _possible(self, sums, rest, lengths, slack, k):
        """Members and queries where an upper bound reaches a lower bound of the k-th best."""
        off = np.multiply.outer(rest.astype(sums.dtype), lengths) + sums.dtype.type(slack)
        low, n = sums - off, len(sums)
        # the highest of disjoint handfuls of members: as many of them reach its k-th highest
        of = 8 if n >= 16 * k else 1
        tops = low[: n // of * of].reshape(n // of, of, -1).max(1) if of > 1 else low
        tops = np.ascontiguousarray(tops.T)
        least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] if tops.shape[1] >= k else np.full(len(lengths), -np.inf, sums.dtype)
        high = sums + off
        if slack:
            # scores beyond a long tie at its ends
            least, high = np.minimum(least, END), np.maximum(high, -END)
        reach = high >= least
        reach &= sums > -np.inf
        return np.nonzero(reach)


def build(vectors: DataFrame, lengths: dict[int, tuple[int, float]], levels: int = LEVELS, rows: int | None = None) -> DataFrame:
    """The written index of ``vectors`` (see ``blocks.integers``), a row a block. Rows are dealt by a hash of their number."""
    counts, base = {}, 0
    for dim, (n, _) in sorted(lengths.items()):
        counts[dim] = (base, made := -(-n // (rows or rows_of(n, dim))))
        base += made
    number = F.lit(None).cast("int")
    for dim, (first, made) in counts.items():
        number = F.when(F.col("dim") == dim, F.pmod(F.xxhash64("row"), F.lit(made)).cast("int") + first).otherwise(number)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        v = narrow(matrix(table["q"]))
        members, edges, rests = segments(v, levels)
        packed = [table["id"].to_numpy().astype("<i8"), table["row"].to_numpy().astype("<i8"), v, members, edges, rests.astype("<f4")]
        return pa.table([[v.shape[1]], table["number"][:1], [v.itemsize], *([x.tobytes()] for x in packed)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("number", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "vectors", "members", "edges", "rests"))])
    return stage(vectors.withColumn("number", number).groupBy("number").applyInArrow(make, INDEX), "impact_index")


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each query the ``k`` members with the highest scores, ties to the smaller id: columns of ``FOUND`` and ``rank``.

    ``queries`` has ``row`` (its own row in the index, which doesn't count), ``id``, ``dim`` and ``q``.
    """
    names = ["query_row", "query_id", "vec_id", "vec_row", "score"]

    def answer(block: Block, batch: pa.RecordBatch):
        row, ids, u = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
        query, member, score, _ = block.best(u, row.tolist(), k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row[query], ids[query], block.ids[member], block.rows[member], score)], names)

    found = meet(index.withColumn("dim_", F.col("dim")), queries.select("dim", "row", "id", "q"), Block, answer, FOUND, BATCH)
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", asked: Column | None = None, factor: int = FACTOR, k: int = K, levels: int = LEVELS, rows: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that ``asked`` names (by default ids divisible by ``EVERY``) its best others.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; vectors of different lengths
    don't meet. Repeated rows are rows of their own: each is asked, and finds the others. With fewer than ``k`` others all are returned; an empty
    table gives no rows. A score beyond a long stays at its end. Other columns are left out.
    """
    held, lengths = integers(vectors, id_col, vector_col, factor)
    index = build(held, lengths, levels, rows)
    queries = held.where(F.col("id") % EVERY == 0 if asked is None else asked)
    return search(index, queries, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
