"""Exact nearest vectors by matrix products: each vector is read once, and a task keeps k hits a question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of questions that go to every task at a time, and products that a task holds.
QUESTION_BYTES, PRODUCTS = 64 << 20, 1 << 22
#: Digits of a score that count; equal scores tie.
DIGITS = 9


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows and rows with components that aren't finite become nan."""
    rows = np.asarray(rows, float)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0.0)
        return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Questions:
    """A block of questions, by their number of dimensions, as matrices."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.array([0 if r[1] is None else len(r[1]) for r in rows], int)
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            unit = units(np.array([rows[i][1] for i in at], float))
            fine = ~np.isnan(unit).any(1)
            self.by_dim[dim] = at[fine], unit[fine]


class Cells:
    """Which questions of a block read a cell: those that list it; with a ``limit``, those that don't, but may have hits within that angle in it.

    The questions' lists are all that is held for questions and cells together; what lies within a limit is told where a cell's vectors are read.
    """

    def __init__(self, lists: np.ndarray, centres: np.ndarray, reach: np.ndarray, limit: np.ndarray | None = None):
        flat = lists.ravel()
        order = np.argsort(flat, kind="stable")
        self.question = (order // max(1, lists.shape[1])).astype(np.int32)
        self.start = np.searchsorted(flat, np.arange(len(centres) + 1), sorter=order)
        self.centres, self.reach, self.limit = centres, reach, limit

    def of(self, cell: int, unit: np.ndarray) -> np.ndarray:
        """The places in ``unit``, the block's questions, of those that read the cell."""
        listed = self.question[self.start[cell] : self.start[cell + 1]]
        if self.limit is None:
            return listed
        able = angles(unit, self.centres[cell]) - self.reach[cell] <= self.limit
        able[listed] = False
        return np.flatnonzero(able)


def angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


class Best:
    """The best k hits of each question so far: by score, then newest, then key. They lie in arrays of k a question, whatever the number of rows that were met."""

    def __init__(self, ids: list, k: int, own: bool = False, least: np.ndarray | None = None):
        self.ids, self.k, self.own = ids, k, own
        n = len(ids)
        self.least, self.held = np.full(n, -np.inf) if least is None else np.round(least, DIGITS), np.zeros(n, int)
        self.score, self.time, self.key = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k), object)

    def take(self, at: np.ndarray, score: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
        """Meet rows: ``score`` has a row for each of the questions ``at``, minus infinity where they don't match."""
        rounded = np.round(score, DIGITS)
        least, most = self.least[at], self.k + self.own
        fine = rounded >= least[:, None]
        if rounded.shape[1] > most and np.count_nonzero(fine) > 4 * most * len(at):
            fine = rounded >= np.maximum(least, np.partition(rounded, -most, axis=1)[:, -most])[:, None]
        fine &= rounded > -np.inf
        q, v = np.nonzero(fine)
        if self.own and len(q):
            other = np.array([keys[j] != self.ids[i] for i, j in zip(at[q].tolist(), v.tolist())], bool)
            q, v = q[other], v[other]
        if not len(q):
            return
        touched, new = np.unique(at[q], return_inverse=True)
        o, place = np.nonzero(np.arange(self.k) < self.held[touched][:, None])
        was = touched[o], place
        group = np.concatenate((o, new))
        raw, time = np.concatenate((self.score[was], score[q, v])), np.concatenate((self.time[was], times[v]))
        key = np.concatenate((self.key[was], keys[v].astype(object)))
        order = np.lexsort((_ranks(key), -time, -np.round(raw, DIGITS), group))
        group = group[order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        kept = place < self.k
        to = touched[group[kept]], place[kept]
        order = order[kept]
        self.score[to], self.time[to], self.key[to] = raw[order], time[order], key[order]
        self.held[touched] = np.minimum(self.k, np.bincount(group, minlength=len(touched)))
        full = touched[self.held[touched] == self.k]
        self.least[full] = np.round(self.score[full, self.k - 1], DIGITS)

    def rows(self) -> Iterator[tuple[list, list, list, list]]:
        """What is held, as columns: question, key, time, score; in parts of bounded size."""
        q, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        for start in range(0, len(q), 10_000):
            i, j = q[start : start + 10_000], place[start : start + 10_000]
            yield [self.ids[n] for n in i.tolist()], self.key[i, j].tolist(), self.time[i, j].tolist(), self.score[i, j].tolist()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of the keys; a null comes first."""
    some, out = np.array([x is not None for x in keys], bool), np.full(len(keys), -1)
    out[some] = np.unique(keys[some], return_inverse=True)[1]
    return out


def keys_of(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


#: Times as microseconds; what has none is older than all.
NEVER = -(1 << 62)


def hits_of(question: T.DataType, key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("question_id", question), T.StructField("key", key), T.StructField("at", T.LongType()), T.StructField("score", T.DoubleType())])


def scored(vectors: DataFrame, questions: Questions, k: int, own: bool, question_type: T.DataType, cells: Cells | None = None, least: np.ndarray | None = None) -> DataFrame:
    """(question_id, key, at, score): each task's best k for each question, of those that reach the question's ``least``. ``vectors``: key, embedding, at (microseconds), and cell if these are told apart."""
    schema = hits_of(question_type, vectors.schema["key"].dataType)
    types = [to_arrow_type(f.dataType) for f in schema]
    source = vectors.select("key", "embedding", "at", *([] if cells is None else ["cell"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(questions.ids, k, own, least)
        for batch in batches:
            keys, rows = keys_of(batch.column(0)), batch.column(1)
            times = batch.column(2).fill_null(NEVER).to_numpy(zero_copy_only=False)
            size = np.array(rows.value_lengths().fill_null(0))
            cell = np.zeros(len(keys), int) if cells is None else batch.column(3).to_numpy()
            for dim, (every, asked) in questions.by_dim.items():
                for c in np.unique(cell[size == dim]).tolist():
                    met = slice(None) if cells is None else cells.of(c, asked)
                    to, of = every[met], asked[met]
                    if not len(to):
                        continue
                    at = np.flatnonzero((size == dim) & (cell == c))
                    unit = units(rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
                    fine = ~np.isnan(unit).any(1)
                    at, unit = at[fine], unit[fine]
                    for part in pieces(len(at), len(to)):
                        best.take(to, np.round(of @ unit[part].T, DIGITS), keys[at[part]], times[at[part]])
        for columns in best.rows():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return source.mapInArrow(run, schema)


def merged(hits: DataFrame, k: int) -> DataFrame:
    """Each question's best ``k`` of all tasks' hits, with ``pos`` and ``updated_at``."""
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", DIGITS)), F.desc("at"), "key")
    found = hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return found.select("question_id", "key", "score", F.when(F.col("at") != NEVER, F.timestamp_micros("at")).alias("updated_at"), "pos")


def pieces(n: int, width: int) -> Iterator[slice]:
    """``n`` rows in parts that make no more than ``PRODUCTS`` with ``width`` others."""
    step = max(1, PRODUCTS // max(1, width))
    return (slice(start, start + step) for start in range(0, n, step))


def blocks_of(questions: DataFrame, most: int | None = None) -> Iterator[list[tuple]]:
    """The questions in blocks of bounded size, ``most`` in one, on the driver."""
    widest = questions.agg(F.max(F.size("embedding"))).first()[0] or 1
    block, held = max(1, min(QUESTION_BYTES // (8 * max(1, widest)), most or QUESTION_BYTES)), []
    for r in questions.select("question_id", "embedding").toLocalIterator():
        held.append((r[0], None if r[1] is None else np.array(r[1], float)))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def with_times(vectors: DataFrame) -> DataFrame:
    at = F.unix_micros("updated_at") if "updated_at" in vectors.columns else F.lit(None).cast("long")
    return vectors.withColumn("at", at)


def nearest(vectors: DataFrame, questions: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(question_id, key, score, updated_at, pos): each question's ``k`` nearest vectors of its length by cosine, all compared.

    Ties go to the newest, then to the smallest key; with ``own`` the vector whose key is the question's doesn't count. Questions go to the tasks in blocks of
    ``QUESTION_BYTES``; each block reads the vectors once and shuffles k hits a question and task. Zero vectors and such as
    hold components that aren't finite are near nothing.
    """
    kind, out = questions.schema["question_id"].dataType, None
    source = with_times(vectors)
    for rows in blocks_of(questions):
        part = scored(source, Questions(rows), k, own, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = scored(source, Questions([]), k, own, kind)
    return merged(out, k)
