"""A stored vector index: inverted cells, kept up by the change stream.

Centroids are fitted once on a bounded sample, in the tasks; every vector lies in the cell of its nearest centroid. Three tables of the store hold the index: ``rows``
in buckets of cells, ``places`` with each key's cell in buckets of keys, and ``reach`` with each cell's widest angle. A batch of changes rewrites
the buckets of the cells that its vectors leave and enter, in one commit with whatever else the batch changes.

A search reads the cells nearest to each question. With ``probe`` it reads so many and is approximate. Without, it is exact: after the first
cells, a question's k-th best score and the triangle inequality on angles tell which other cells can hold a better one, and only these are read. Which questions
read a cell is told in the tasks that read it, so the driver holds a block of questions and the centroids, but nothing for questions and cells together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.merge import upsert
from millrace.operators.nearest import DIGITS, Cells, Questions, angles, blocks_of, merged, pieces, scored, units, with_times
from millrace.streaming.store import Store

#: Rows that centroids are fitted on for each cell, rounds of the fit, and most cells.
SAMPLE, ROUNDS, CELLS, SEED = 64, 8, 4096, 17
#: Cells that an exact search reads first, and most entries of the questions' lists of cells at a time.
FIRST, LISTED = 4, 1 << 22
#: Far above the error of an angle between unit vectors in double precision.
SLACK = 1e-6


def matrix(rows: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def usable(rows: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of ``dim`` numbers that are near anything, and their units."""
    at = np.flatnonzero(np.array(rows.value_lengths().fill_null(0)) == dim)
    unit = units(matrix(rows.take(pa.array(at)), dim))
    fine = ~np.isnan(unit).any(1)
    return at[fine], unit[fine]


def closest(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and the cosine."""
    cell, near = np.zeros(len(unit), int), np.zeros(len(unit))
    for part in pieces(len(unit), len(centres)):
        product = unit[part] @ centres.T
        cell[part], near[part] = product.argmax(1), product.max(1)
    return cell, near


def fitted(sample: DataFrame, cells: int, dim: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of a sample (key, cell, embedding of length one) by rounds of assignment and mean; a cell that goes empty starts anew at a row.

    The tasks add up their rows by cell; the driver holds the centroids and as many rows more.
    """
    rows = units(matrix(sample.orderBy(F.xxhash64(F.lit(seed), "key")).limit(2 * cells).select("embedding").toArrow()["embedding"], dim))
    if not len(rows):
        raise ValueError("an index needs vectors to fit its cells on")
    centres, others = rows[:cells], cycle(rows[::-1])
    shape = centres.shape

    def added(cell_of: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, met = np.zeros(shape), np.zeros(shape[0], bool)
            for batch in batches:
                held = matrix(batch.column(1), dim)
                cell = cell_of(batch.column(0).to_numpy(), held)
                np.add.at(sums, cell, held)
                met[cell] = True
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met), pa.int32()), lists(sums[met])], ["cell", "embedding"])

        return run

    kind = "cell int, embedding array<double>"
    for _ in range(rounds):
        parts = sample.select("cell", "embedding").mapInArrow(added(lambda _, unit, centres=centres: closest(unit, centres)[0]), kind)
        found = parts.repartition("cell").mapInArrow(added(lambda cell, _: cell), kind).toArrow()
        sums = np.zeros(shape)
        sums[found["cell"].to_numpy()] = matrix(found["embedding"], dim)
        size = np.sqrt((sums * sums).sum(1))
        for c in np.flatnonzero(size == 0):
            sums[c], size[c] = next(others), 1.0
        centres = sums / size[:, None]
    return centres


def state_buckets(state: dict, table: str) -> int:
    return state["tables"][table]["buckets"]


@dataclass
class Reading:
    """What a search has read: cells for each question on average, and cells in all."""

    cells_a_question: float = 0.0
    cells: set = field(default_factory=set)


class VectorIndex:
    """An index named ``name`` in a store. Keys are of one column, ``key``."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self.rows, self.places, self.reach, self.centres = (f"{name}.{x}" for x in ("rows", "places", "reach", "centres"))

    def exists(self, state: dict | None = None) -> bool:
        return self.store.exists(self.centres, state)

    def centroids(self, state: dict | None = None) -> np.ndarray:
        """No more than ``CELLS`` rows."""
        held = self.store.read(self.centres, state=state).orderBy("cell").toArrow()["centre"].combine_chunks()
        return matrix(held, len(held[0]))

    def assigned(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        """key, embedding, updated_at, cell and the angle ``off`` the centroid; vectors that are near nothing are left out."""
        kind = vectors.schema["key"].dataType
        schema = T.StructType([T.StructField("key", kind), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("updated_at", T.TimestampType()), T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])
        updated = F.col("updated_at") if "updated_at" in vectors.columns else F.lit(None).cast("timestamp")
        dim = centres.shape[1]

        def run(batches):
            for batch in batches:
                at, unit = usable(batch.column(1), dim)
                cell, near = closest(unit, centres)
                off = np.arccos(np.clip(near, -1, 1))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array(off)], schema.names)

        return vectors.select("key", F.col("embedding").cast("array<float>").alias("embedding"), updated.alias("updated_at")).mapInArrow(run, schema)

    def build(self, vectors: DataFrame, cells: int | None = None, query: str | None = None, batch: int | None = None) -> None:
        """Fit the cells and index every vector of the commonest length. Without ``cells``: four times the root of their number, ``CELLS`` at most."""
        common = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        n, dim = (common.n, common.dim) if common else (0, 0)
        cells = max(1, min(CELLS, cells or 4 * math.isqrt(n)))
        spark, base = self.store.spark, self.store.manifest()
        sample = self._sample(vectors, dim, min(1.0, SAMPLE * cells / max(1, n))).persist()
        try:
            centres = fitted(sample, cells, dim)
        finally:
            sample.unpersist()
        held = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(centres)), pa.int32()), "centre": lists(centres)}), "cell int, centre array<double>")
        rows = self.assigned(vectors, centres).persist()
        try:
            tables = {self.centres: (held, ["cell"], None), self.rows: (rows, ["cell"], None), self.places: (rows.select("key", "cell"), ["key"], None), self.reach: (self._reach(rows), ["cell"], None)}
            self.store.commit(tables, query, batch, base=base)
        finally:
            rows.unpersist()

    def _sample(self, vectors: DataFrame, dim: int, share: float) -> DataFrame:
        """(key, cell, embedding): a share of the vectors of ``dim`` numbers, scaled to length one. The cell isn't known yet."""
        schema = T.StructType([vectors.schema["key"], T.StructField("cell", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = usable(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.zeros(len(at)), pa.int32()), lists(unit.astype(np.float32))], schema.names)

        drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
        return vectors.where(F.size("embedding") == dim).where(drawn).select("key", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, schema)

    def _reach(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell").agg(F.max("off").alias("off"), F.count("*").alias("n"))

    def changes(self, vectors: DataFrame, deletes: DataFrame, base: dict) -> dict:
        """The tables to commit for vectors that are new or changed and keys that are gone, made from the manifest ``base``."""
        s = self.store
        new = self.assigned(vectors, self.centroids(base)).persist()
        gone = deletes.select("key")
        keys = new.select("key").unionByName(gone).distinct()
        by_key = s.touched(keys, ["key"], self.places, base)
        places = s.read(self.places, by_key, base)
        cells = places.join(keys, "key").select("cell").unionByName(new.select("cell"))
        by_cell = s.touched(cells, ["cell"], self.rows, base)
        rows = upsert(s.read(self.rows, by_cell, base).join(keys, "key", "left_anti"), new, gone, ["key"])
        # the reach lies in buckets of the same cells
        same = state_buckets(base, self.rows) == state_buckets(base, self.reach)
        reach = self._reach(rows) if same else self._reach(upsert(s.read(self.rows, None, base).join(keys, "key", "left_anti"), new, gone, ["key"]))
        return {
            self.rows: (rows, ["cell"], by_cell),
            self.places: (upsert(places, new.select("key", "cell"), gone, ["key"]), ["key"], by_key),
            self.reach: (reach, ["cell"], by_cell if same else None),
        }

    def apply(self, vectors: DataFrame, deletes: DataFrame, query: str | None = None, batch: int | None = None) -> bool:
        """Take up a batch of changes; False if the query has committed it before."""
        base = self.store.manifest()
        if query is not None and batch is not None and self.store.committed(query, base) >= batch:
            return False
        return self.store.commit(self.changes(vectors, deletes, base), query, batch, base=base)

    def _read(self, cells: Sequence[int], state: dict) -> DataFrame:
        """The vectors of some cells, from the buckets that hold them."""
        s, entry = self.store, state["tables"][self.rows]
        wanted = s.spark.createDataFrame([(int(c),) for c in cells], "cell int")
        buckets = sorted(r[0] for r in wanted.select(s.bucket(["cell"], entry["buckets"])).distinct().collect())
        return s.read(self.rows, buckets, state).where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, questions: DataFrame, k: int, probe: int | None = None, reading: Reading | None = None, own: bool = False) -> DataFrame:
        """(question_id, key, score, updated_at, pos) as ``nearest.nearest``: from the ``probe`` nearest cells, or exactly."""
        state = self.store.manifest()
        centres, kind = self.centroids(state), questions.schema["question_id"].dataType
        reach = np.full(len(centres), -1.0)
        for r in self.store.read(self.reach, state=state).collect():  # a row a cell
            reach[r.cell] = r.off
        filled, out, asked, read = np.flatnonzero(reach >= 0).astype(np.int32), None, 0, 0
        reading = reading or Reading()
        n = min(probe or FIRST, len(filled))
        for rows in blocks_of(questions, LISTED // max(1, n)):
            block = Questions(rows)
            at, unit = block.by_dim.get(centres.shape[1], (np.zeros(0, int), np.zeros((0, centres.shape[1]))))
            first = np.zeros((len(at), n), np.int32)
            for part in pieces(len(at), len(filled)) if n else ():
                first[part] = filled[np.argpartition(angles(unit[part], centres[filled]), n - 1, axis=1)[:, :n]]
            needed = np.zeros(len(centres), bool)
            needed[first] = True
            hits = self._hits(block, Cells(first, centres, reach), needed, state, k, own, kind, reading)
            asked += len(at)
            read += first.size
            if probe is None and len(at) and n:
                hits = hits.persist()
                # a row a question of the block
                held = {r.question_id: r.score for r in merged(hits, k).where(F.col("pos") == k).select("question_id", "score").collect()}
                least = np.array([held.get(q, -np.inf) for q in block.ids])
                # a score that rounds to the k-th may be a hit
                limit = np.where(least[at] > -np.inf, np.arccos(np.clip(least[at] - 10.0**-DIGITS, -1, 1)) + SLACK, np.inf)
                needed = np.zeros(len(centres), bool)
                for part in pieces(len(at), len(centres)):
                    able = (angles(unit[part], centres) - reach <= limit[part, None]) & (reach >= 0)
                    np.put_along_axis(able, first[part], False, axis=1)
                    read += np.count_nonzero(able)
                    needed |= able.any(0)
                if needed.any():
                    hits = hits.unionByName(self._hits(block, Cells(first, centres, reach, limit), needed, state, k, own, kind, reading, least))
            out = hits if out is None else out.unionByName(hits)
        reading.cells_a_question = read / max(1, asked)
        if out is None:
            out = scored(with_times(self.store.read(self.rows, state=state).limit(0)), Questions([]), k, own, kind)
        return merged(out, k)

    def _hits(self, block: Questions, cells: Cells, needed: np.ndarray, state, k, own, kind, reading, least: np.ndarray | None = None) -> DataFrame:
        """The best of the needed cells. Their vectors come cell by cell, so a task tells but once or twice which questions read one."""
        wanted = np.flatnonzero(needed).tolist()
        reading.cells.update(wanted)
        source = self._read(wanted, state) if wanted else self.store.read(self.rows, state=state).limit(0)
        return scored(with_times(source).sortWithinPartitions("cell"), block, k, own, kind, cells, least)
