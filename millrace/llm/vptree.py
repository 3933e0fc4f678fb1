"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, the root of what a vector's squared length lacks of the largest one, all rows have one length, and for an anchor (with 0
there) the squared distance to a row is a constant less twice the score. So the highest scores are the nearest rows, and a window of scores is an
annulus of distances around the anchor.

Rows are dealt to cells by the upper levels of a tree grown on a bounded sample; cells over a block's size are dealt on to several
blocks. Each block holds a tree of its own rows: a node splits its rows in halves by their distance to a vantage point and keeps both halves' least and
largest distance. A traversal takes nodes nearest first, leaves out those that the triangle inequality puts inside or outside
the annulus, and ends when the k-th row found lies nearer than any node left. Scores are exact integers; distances only steer.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import integers, matrix, meet, narrow, rows_of
from .common import quoted, stage

FACTOR, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows of a leaf; rows that the upper levels are grown on, for each block at least ``EACH``.
LEAF, SAMPLE, EACH = 256, 4096, 8
INDEX = "dim int, number int, width int, most double, ids binary, rows binary, labels binary, vectors binary, spans binary, vantages binary, ranges binary"


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that brings them to the squared length ``most``."""
    v = v.astype(float)
    return np.column_stack((v, np.sqrt(np.maximum(0.0, most - (v * v).sum(1)))))


def _split(points: np.ndarray, at: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A vantage point among the rows ``at``, the rows by their distance to it, and these distances."""
    far = ((points[at] - points[at[0]]) ** 2).sum(1)
    vantage = int(at[far.argmax()])
    to = np.sqrt(((points[at] - points[vantage]) ** 2).sum(1))
    by = np.argsort(to, kind="stable")
    return vantage, at[by], to[by]


def grown(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and of each node its span there, vantage point (-1: a leaf) and its rows' least and largest distance to its parent's.

    The children of node i, where it has any, are 2i+1 and 2i+2; nodes that aren't there have empty spans.
    """
    order = np.arange(len(points))
    spans, vantages, ranges = [(0, len(points))], [-1], [(0.0, np.inf)]
    i = 0
    while i < len(spans):
        a, b = spans[i]
        if b - a > leaf:
            while len(spans) < 2 * i + 3:
                spans.append((0, 0))
                vantages.append(-1)
                ranges.append((0.0, np.inf))
            vantages[i], order[a:b], to = _split(points, order[a:b])
            half = (b - a + 1) // 2
            for child, start, stop in ((2 * i + 1, a, a + half), (2 * i + 2, a + half, b)):
                spans[child], ranges[child] = (start, stop), (to[start - a], to[stop - a - 1])
        i += 1
    return order, np.array(spans, np.int64), np.array(vantages, np.int64), np.array(ranges)


class Tree:
    """A block's tree; members stand in its order."""

    def __init__(self, row: dict):
        dim, self.most = row["dim_"], row["most"]
        self.ids, self.rows, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows", "labels"))
        self.v = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dim)
        self.spans = np.frombuffer(row["spans"], "<i8").reshape(-1, 2).tolist()
        vantages = np.frombuffer(row["vantages"], "<i8")
        self.inner = np.flatnonzero(vantages >= 0)
        self.vantage = self.v[vantages[self.inner]].astype(float)
        self.ranges = np.frombuffer(row["ranges"], "<f8").reshape(-1, 2).tolist()
        self.norm = float(np.sqrt((self.v.astype(float) ** 2).sum(1)).max(initial=0.0))

    def visit(self, a: np.ndarray) -> Visit:
        return Visit(self, a)


class Visit:
    """One anchor in a tree; leaves are scored once, however many annuli it asks for."""

    def __init__(self, tree: Tree, a: np.ndarray):
        self.tree, self.a, self.scored = tree, a, {}
        square = float((a.astype(float) ** 2).sum())
        self.sum = square + tree.most
        self.exact = tree.norm * np.sqrt(square) < 1 << 53
        # far above the rounding of a distance
        self.off = 1e-7 * np.sqrt(self.sum)
        self.to = dict(zip(tree.inner.tolist(), np.sqrt(np.maximum(0.0, self.sum - 2 * (tree.vantage @ a.astype(float)))).tolist()))

    def scores(self, node: int) -> np.ndarray:
        if node not in self.scored:
            v = self.tree.v[slice(*self.tree.spans[node])]
            if self.exact:
                self.scored[node] = (v.astype(float) @ self.a.astype(float)).astype(np.int64)
            else:
                a = self.a.tolist()
                whole = (sum(x * y for x, y in zip(row, a, strict=True)) for row in v.tolist())
                self.scored[node] = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], np.int64)
        return self.scored[node]

    def distance(self, score: int) -> float:
        return float(np.sqrt(max(0.0, self.sum - 2.0 * score)))

    def nearest(self, k: int, fits, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Members and scores of the ``k`` nearest rows of the annulus that ``fits`` allows, best first, ties to the smaller id, and the leaves read.

        ``fits`` gets a span of members; ``low`` and ``high`` are the window of scores.
        """
        t = self.tree
        inner = 0.0 if high is None else self.distance(high) - self.off
        outer = np.inf if low is None else self.distance(low) + self.off
        member, score, reach, read = np.zeros(0, np.int64), np.zeros(0, np.int64), np.inf, 0
        nodes = [(inner, 0)]
        while nodes:
            least, node = heapq.heappop(nodes)
            if least > reach:
                break
            if node in self.to:
                d = self.to[node]
                for child in (2 * node + 1, 2 * node + 2):
                    lo, hi = t.ranges[child]
                    near = max(least, d - hi - self.off, lo - d - self.off)
                    if near <= min(outer, reach) and d + hi + self.off >= inner:
                        heapq.heappush(nodes, (near, child))
                continue
            read += 1
            start, stop = t.spans[node]
            s = self.scores(node)
            able = fits(start, stop)
            if low is not None:
                able = able & (s >= low)
            if high is not None:
                able = able & (s <= high)
            if len(score) == k:
                able = able & (s >= score[-1])
            some = np.flatnonzero(able)
            if not len(some):
                continue
            member, score = np.concatenate((member, some + start)), np.concatenate((score, s[some]))
            # all bits flipped: descending without overflow
            best = np.lexsort((t.rows[member], t.ids[member], ~score))[:k]
            member, score = member[best], score[best]
            if len(score) == k:
                reach = self.distance(int(score[-1])) + self.off
        return member, score, read


class Upper:
    """The upper levels: which cell a row goes to."""

    def __init__(self, sample: np.ndarray, most: float, depth: int):
        self.most, self.depth = most, depth
        points = augmented(sample, most)
        self.points, self.radius = {}, {}
        held = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            at = held.pop(node)
            half = (len(at) + 1) // 2
            if len(at) > 1:
                vantage, at, to = _split(points, at)
                self.points[node], self.radius[node] = points[vantage], (to[half - 1] + to[half]) / 2
            held[2 * node + 1], held[2 * node + 2] = at[:half], at[half:]

    def cells(self, v: np.ndarray) -> np.ndarray:
        points, node = augmented(v, self.most), np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            right = np.zeros(len(v), np.int64)
            for n in np.unique(node).tolist():
                if n in self.points:
                    at = np.flatnonzero(node == n)
                    right[at] = np.sqrt(((points[at] - self.points[n]) ** 2).sum(1)) > self.radius[n]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def build(vectors: DataFrame, lengths: dict[int, tuple[int, float]], leaf: int = LEAF, rows: int | None = None) -> DataFrame:
    """The written index of ``vectors`` (see ``blocks.integers``, with ``label``), a row a block."""
    uppers, size = {}, {}
    for dim, (n, most) in sorted(lengths.items()):
        size[dim] = rows or rows_of(n, dim)
        depth = max(0, -(-n // size[dim]) - 1).bit_length()
        sample = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("row")).limit(max(SAMPLE, EACH << depth)).select("q").toArrow() if depth else None
        uppers[dim] = Upper(matrix(sample["q"]), most, depth) if depth else None
    celled = vectors.schema.simpleString()[len("struct<") : -1] + ",cell:int"

    def deal(batches):
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if uppers[dim]:
                    at = np.flatnonzero(dims == dim)
                    cell[at] = uppers[dim].cells(matrix(batch.column("q").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    dealt = stage(vectors.mapInArrow(deal, T._parse_datatype_string(f"struct<{celled}>")), "cells")
    full = F.lit(1)
    for dim, most in size.items():
        full = F.when(F.col("dim") == dim, F.lit(most)).otherwise(full)
    # a row a cell
    tiles = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / full).cast("int"))
    w = Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)
    tiles = stage(tiles.withColumn("first", F.coalesce(F.sum("tiles").over(w), F.lit(0)).cast("int")).select("dim", "cell", "tiles", "first"), "tiles")
    numbered = dealt.join(F.broadcast(tiles), ["dim", "cell"]).withColumn("number", F.col("first") + F.pmod(F.xxhash64("row"), "tiles").cast("int")).select("number", "dim", "row", "id", "label", "q")
    schema = pa.schema([("dim", pa.int32()), ("number", pa.int32()), ("width", pa.int32()), ("most", pa.float64()), *((c, pa.binary()) for c in ("ids", "rows", "labels", "vectors", "spans", "vantages", "ranges"))])

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        v = narrow(matrix(table["q"]))
        most = lengths[v.shape[1]][1]
        order, spans, vantages, ranges = grown(augmented(v, most), leaf)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        vantages = np.where(vantages >= 0, place[vantages], -1)
        own = [table[c].to_numpy()[order].astype("<i8") for c in ("id", "row", "label")]
        packed = [x.tobytes() for x in (*own, v[order], spans.astype("<i8"), vantages.astype("<i8"), ranges.astype("<f8"))]
        return pa.table([[v.shape[1]], table["number"][:1], [v.itemsize], [most], *([x] for x in packed)], schema=schema)

    return stage(numbered.groupBy("number").applyInArrow(make, INDEX), "vantage_points")


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchors: Column | None = None, factor: int = FACTOR,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, leaf: int = LEAF, rows: int | None = None,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: a row a hard negative.

    Anchors are the rows that ``anchors`` names (by default ids divisible by ``EVERY``); an anchor's positives are its ``positives`` best other
    rows of its label, its negatives for each the ``negatives`` best rows of other labels with ``low * positive <= 100 * negative <= high * positive``.
    ``label`` is a column of ``vectors``, by default ``label``.

    Rows with a null label or id, or whose vector is null, empty or holds null or non-finite components, take no part; vectors of different lengths don't
    meet. A positive with a negative score has an empty window. Ties go to the smaller id. Repeated rows are rows of their own: each is an anchor,
    and the others' positive. Anchors without a positive or a negative have no rows, nor has an empty table. Other columns are left out.
    """
    label = F.col(quoted("label")) if label is None else label
    labelled = vectors.withColumn("__label", label.cast("long")).where("__label is not null")
    held, lengths = integers(labelled, id_col, vector_col, factor, [F.col("__label").alias("label")], "labelled")
    index = build(held, lengths, leaf, rows)
    index = index.withColumn("dim_", F.col("dim"))
    asked = held.where(F.col("id") % EVERY == 0 if anchors is None else anchors).select("dim", "row", "id", "label", "q")

    def near(tree: Tree, batch: pa.RecordBatch):
        out = []
        for row, anchor, kind, a in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3)), strict=True):
            member, score, _ = tree.visit(a).nearest(positives, lambda i, j: (tree.labels[i:j] == kind) & (tree.rows[i:j] != row))
            out.append((np.full(len(member), row), np.full(len(member), anchor), tree.ids[member], tree.rows[member], score))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64), pa.int64()) for c in zip(*out, strict=True)], ["row", "anchor_id", "positive_id", "positive_row", "positive_score"])

    found = meet(index, asked, Tree, near, "row long, anchor_id long, positive_id long, positive_row long, positive_score long")
    w = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id", "positive_row")
    firsts = stage(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives), "positives")
    # as many windows as an anchor has positives
    windows = asked.join(firsts.groupBy("row").agg(F.collect_set("positive_score").alias("windows")), "row").select("dim", "row", "label", "q", "windows")

    def annuli(tree: Tree, batch: pa.RecordBatch):
        out = []
        for row, kind, a, asked_for in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            visit = tree.visit(a)
            for p in asked_for:
                least, most = -((-low * p) // 100), high * p // 100
                if least <= most:
                    member, score, _ = visit.nearest(negatives, lambda i, j: tree.labels[i:j] != kind, least, most)
                    out.append((np.full(len(member), row), np.full(len(member), p), tree.ids[member], tree.rows[member], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64), pa.int64()) for c in zip(*out, strict=True)], ["row", "positive_score", "negative_id", "negative_row", "negative_score"])

    hard = meet(index, windows, Tree, annuli, "row long, positive_score long, negative_id long, negative_row long, negative_score long")
    w = Window.partitionBy("row", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id", "negative_row")
    best = hard.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return firsts.join(best, ["row", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
