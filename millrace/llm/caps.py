"""Embedding near-duplicates by spherical-cap filters.

Filters are the unit directions of ``CODES`` random product codes. For each, space is cut into two
random orthogonal halves with ``WORDS`` random directions each; a filter is a pair of words, one a half.
A vector belongs to all filters whose inner product with it reaches a threshold (list decoding: only
codes and words that can reach it are looked at); one that reaches none takes its best. Vectors that share
a filter are compared, exactly.

The number of words follows the number of vectors (``words_for``), so that filters stay small: with words as its power 0.6, the vectors that one is compared
with grow by about a power of 0.2 (measured in the tests). The threshold follows from the number of dimensions, the words and the wanted cosine: of ``PAIRS`` seeded random
pairs at just that cosine it leaves the share ``MISS`` without a common filter. So a pair at the
limit is missed with about that chance, in any number of dimensions, and a closer one less often.

A pair shares several filters and counts in the first of them, which each vector's list of filters tells. No
pair leaves its group: a group gives each vector's number of links and, for the components, the
least vector that it reaches there, so what is sent on grows with the vectors, not with the pairs. A filter
with many vectors is dealt to tiles, and each pair of tiles is a group of its own.

Equal vectors are compared once, with their number as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import components, quoted, stage

COSINE, MISS, CODES, SEED = 0.9, 0.003, 64, 5
#: Words a half for up to ``BASE`` vectors, how they grow with the vectors beyond, and the most there are.
WORDS, BASE, GROWTH, MOST = 16, 20_000, 0.6, 256
#: Pairs that the threshold is measured on, and words of a half that are tried for each.
PAIRS, TRIED = 4000, 16
#: Vectors in a tile; of one tile so many rows are compared with the other at a time.
TILE, ROWS = 4096, 512


def words_for(n: int) -> int:
    """How many words a half should have for ``n`` vectors."""
    return min(MOST, 8 * round(WORDS / 8 * max(1.0, n / BASE) ** GROWTH))


class Filters:
    """The product codes for one number of dimensions; without a ``threshold`` it is measured."""

    def __init__(self, dim: int, cosine: float = COSINE, miss: float = MISS, codes: int = CODES, words: int = WORDS, seed: int = SEED, threshold: float | None = None):
        rng = np.random.default_rng([seed, dim])
        self.codes, self.words, cut = codes, words, (dim + 1) // 2
        #: Rows decoded at a time, so that their products with all words stay small.
        self.slice = max(16, 1024 * 16 // words)
        turn, halves = np.linalg.qr(rng.standard_normal((dim, dim)))[0], []
        for _ in range(codes):
            axes = rng.permutation(dim)
            for part in (turn[:, axes[:cut]], turn[:, axes[cut:]]):
                w = rng.standard_normal((part.shape[1], words))
                halves.append(part @ (w / np.linalg.norm(w, axis=0, keepdims=True)) * np.sqrt(0.5) if len(w) else np.zeros((dim, words)))
        #: All words side by side: code, half, word.
        self.table = np.concatenate(halves, axis=1).astype(np.float32)
        self.threshold = self._measured(dim, cosine, miss, rng) if threshold is None else threshold

    def _measured(self, dim: int, cosine: float, miss: float, rng) -> float:
        """The threshold that the share ``miss`` of the pairs don't reach in a common filter.

        Of a half only the ``TRIED`` words that are nearest to both are tried, so it is rather too low than too high.
        """
        u, w = rng.standard_normal((2, PAIRS, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w -= (w * u).sum(1, keepdims=True) * u
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        v = cosine * u + np.sqrt(max(0.0, 1 - cosine * cosine)) * w
        best, tried = np.full(PAIRS, -2.0, np.float32), min(TRIED, self.words)
        for at in range(0, PAIRS, self.slice):
            some = slice(at, at + self.slice)
            ours, theirs = self._products(u[some]), self._products(v[some])
            if tried < self.words:
                top = np.argpartition(-(ours + theirs), tried - 1, axis=3)[..., :tried]
                ours, theirs = np.take_along_axis(ours, top, 3), np.take_along_axis(theirs, top, 3)
            for c in range(self.codes):
                for i in range(tried):
                    met = np.minimum(ours[:, c, 0, i, None] + ours[:, c, 1], theirs[:, c, 0, i, None] + theirs[:, c, 1])
                    best[some] = np.maximum(best[some], met.max(1))
        return float(np.quantile(best, miss))

    def _products(self, unit: np.ndarray) -> np.ndarray:
        return (unit.astype(np.float32) @ self.table).reshape(len(unit), self.codes, 2, self.words)

    def of(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the numbers, ascending, of the filters that it reaches, or of its best one."""
        out = []
        for at in range(0, len(unit), self.slice):
            part = unit[at : at + self.slice]
            got = self._products(part)
            found = self._reached(part, got)
            for i in np.flatnonzero([not len(x) for x in found]):
                c = int(got[i].max(2).sum(1).argmax())
                found[i] = np.array([(c * self.words + got[i, c, 0].argmax()) * self.words + got[i, c, 1].argmax()])
            out += found
        return out

    def _reached(self, unit: np.ndarray, got: np.ndarray | None = None) -> list[np.ndarray]:
        """For each row the filters that it reaches, which may be none."""
        got = self._products(unit) if got is None else got
        most = got.max(3)
        rows, numbers = [], []
        for c in range(self.codes):
            able = np.flatnonzero(most[:, c].sum(1) >= self.threshold)
            first, second = got[able, c, 0], got[able, c, 1]
            # words of the first half that the best of the second can lift over the threshold
            r, i = np.nonzero(first + most[able, c, 1, None] >= self.threshold)
            k, j = np.nonzero(first[r, i, None] + second[r] >= self.threshold)
            rows.append(able[r[k]])
            numbers.append((c * self.words + i[k]) * self.words + j)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        by = np.argsort(row, kind="stable")
        return np.split(number[by], np.searchsorted(row[by], np.arange(1, len(unit))))


def _usable(vector: str):
    """A vector as doubles, null where it can't link: null, empty, zero, or with a component that isn't finite."""
    v = F.col(quoted(vector)).cast("array<double>")
    big = F.array_max(F.transform(v, F.abs))
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (big > 0)
    return F.when(fine, v)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _earlier(lists: list[np.ndarray], number: int) -> np.ndarray:
    """For each member a bit for each filter before ``number`` that several members share, common ones first."""
    held = [x[x < number] for x in lists]
    flat = np.concatenate(held)
    names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.full(len(names), -1)
    shared = np.argsort(-count, kind="stable")[: int((count > 1).sum())]
    place[shared] = np.arange(len(shared))
    row, bit = np.repeat(np.arange(len(held)), [len(x) for x in held]), place[at]
    row, bit = row[bit >= 0], bit[bit >= 0]
    out = np.zeros((len(held), -(-len(shared) // 64)), np.uint64)
    np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let all members that the pairs connect have the least label among them."""
    while len(a):
        x, y = label[a], label[b]
        a, b, x, y = (z[x != y] for z in (a, b, x, y))
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(deeper := label[label], label):
            label[:] = deeper


def _compared(keys, weight, unit, lists, tiles, number: int, p: int, q: int, cosine: float):
    """(key, least key reached, weight linked) of the members that have links whose first common filter is ``number``."""
    by = np.argsort(keys, kind="stable")
    keys, weight, unit, tiles, lists = keys[by], weight[by], unit[by], tiles[by], [lists[i] for i in by]
    left, right = np.flatnonzero(tiles == p), np.flatnonzero(tiles == q)
    before = _earlier(lists, number)
    rough = unit.astype(np.float32)
    # far above the error of a single-precision product of unit vectors
    error = 4e-7 * (unit.shape[1] + 4)
    others = np.ascontiguousarray(rough[right].T)
    label, linked = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    for at in range(0, len(left), ROWS):
        some = left[at : at + ROWS]
        near = rough[some] @ others
        i, j = np.nonzero(near >= cosine - error)
        a, b, near = some[i], right[j], near[i, j]
        once = (a < b) if p == q else np.ones(len(a), bool)
        a, b, near = a[once], b[once], near[once]
        for w in range(before.shape[1]):
            first = (before[a, w] & before[b, w]) == 0
            a, b, near = a[first], b[first], near[first]
        doubtful = np.flatnonzero(near < cosine + error)
        fine = np.ones(len(a), bool)
        fine[doubtful] = np.einsum("ij,ij->i", unit[a[doubtful]], unit[b[doubtful]]) >= cosine
        a, b = a[fine], b[fine]
        np.add.at(linked, a, weight[b])
        np.add.at(linked, b, weight[a])
        _joined(label, a, b)
    held = np.flatnonzero(linked)
    return keys[held], keys[label[held]], linked[held]


LINKED = "key long, least long, linked long"


def cap_links(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, codes: int = CODES, words: int | None = None, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """Links between the vectors ``v`` of ``key`` (long, one row each) with weight ``n``, at ``cosine`` or above.

    Rows (key, least, linked): in some group the vector ``key`` has links to other vectors of weight
    ``linked`` and reaches the vector ``least``. Each link found counts once on either side.
    """
    element = vectors.schema["v"].dataType.elementType
    words = words or words_for(vectors.count())
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(element)), T.StructField("dim", T.IntegerType()), T.StructField("filters", T.ArrayType(T.IntegerType()))])
    stored = to_arrow_type(element)
    number = "short" if codes * words * words < 1 << 15 else "int"
    # a row a length of vectors; what is measured is measured once
    thresholds = {r.dim: Filters(r.dim, cosine, miss, codes, words, seed).threshold for r in vectors.select(F.size("v").alias("dim")).distinct().collect()}

    def decode(batches):
        made: dict[int, Filters] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                vs = batch.column(2).to_pylist()
                by_dim: dict[int, list[int]] = {}
                for i, v in enumerate(vs):
                    by_dim.setdefault(len(v), []).append(i)
                found: list = [None] * len(vs)
                for dim, at in by_dim.items():
                    if dim not in made:
                        made[dim] = Filters(dim, cosine, miss, codes, words, seed, thresholds[dim])
                    for i, x in zip(at, made[dim].of(_unit(np.array([vs[i] for i in at], float))), strict=True):
                        found[i] = x
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.list_(stored)), pa.array(map(len, vs), pa.int32()), pa.array(found, pa.list_(pa.int32()))], schema.names)

    decoded = stage(vectors.select("key", F.col("n").cast("long").alias("n"), "v").mapInArrow(decode, schema), "filters")
    member = decoded.select("dim", F.explode("filters").alias("filter"), "key", "n", "v", F.col("filters").cast(f"array<{number}>").alias("filters"))
    crowded = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count("*").alias("m")).where(F.col("m") > tile)
    # filters of more than a tile: no more than a code's filters for each length, of ``tile`` vectors or more each
    crowded = stage(crowded.select("dim", "filter", F.ceil(F.col("m") / tile).cast("int").alias("tiles")), "crowded_filters")
    dealt = member.join(crowded, ["dim", "filter"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = dealt.select("dim", "filter", F.least("tile", "o").alias("p"), F.greatest("tile", "o").alias("q"), "tile", "key", "n", "v", "filters")
    group = ["dim", "filter", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie together in the sorted rows; no more than one is held."""
        held: list[pa.RecordBatch] = []
        name = None

        def done():
            t = pa.Table.from_batches(held)
            if t.num_rows < 2:
                return None
            unit = _unit(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1))
            flat = t["filters"].combine_chunks()
            ends = np.cumsum(np.diff(flat.offsets.to_numpy()))
            lists = np.split(flat.flatten().to_numpy().astype(np.int64), ends[:-1])
            _, number, p, q = name
            return _compared(t["key"].to_numpy(), t["n"].to_numpy(), unit, lists, t["tile"].to_numpy(), number, p, q, cosine)

        out: list[tuple] = []
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                at = tuple(ids[:, a].tolist())
                if at != name:
                    if held and (found := done()):
                        out.append(found)
                    held, name = [], at
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["key", "least", "linked"])
                out = []
        if held and (found := done()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["key", "least", "linked"])

    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, LINKED)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, **options) -> DataFrame:
    """One row a vector: the id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Repeated rows and equal vectors count as other vectors linked directly. The
    component is the smallest id reachable; a null id is its own component and never kept. Other columns are left out.
    """
    plain = vectors.select(F.col(quoted(id_col)).alias("id"), _usable(vector_col).alias("v"))
    all_rows = stage(plain, "vectors")
    groups = stage(all_rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "distinct_vectors")
    kind = vectors.schema[vector_col].dataType
    short = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    links = stage(cap_links(groups.select("key", "n", F.col("v").cast("array<float>") if short else "v"), cosine, **options), "links")
    degree = links.groupBy("key").agg(F.sum("linked").alias("linked"))
    classes = components(links, "key", "least").withColumnRenamed("node", "key")
    told = groups.join(degree, "key", "left").join(classes, "key", "left").withColumn("class", F.coalesce("component", "key"))
    # written, so that the join on the class can be split where one class is large
    least = stage(told.groupBy("class").agg(F.min("least").alias("component_id")), "classes")
    by_vector = told.join(least, "class").select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    found = all_rows.join(by_vector, "v", "left")
    component = F.coalesce("component_id", "id")
    return found.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
