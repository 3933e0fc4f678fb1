"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

Documents become token ids with an end id. They are dealt to shards of about ``shard_tokens``
tokens by their strongest term, the one with the largest BM25 weight among those that other documents hold too: the
terms lie side by side on a line, each as long as its documents have tokens, and shards are equal cuts of it. A seed is answered by its own
shard alone, so of its best neighbours in the whole corpus only some are in reach, the fewer the more shards there are (figures in the README).
Each shard has its own BM25 index over token ids, with document frequencies and the mean length
counted over all documents. A window starts with a seed (what the last window cut off, or the
next unused document); the shard's unused neighbours of the seed, scored by all of its terms, best first, fill it, and the last is cut at its
end. So all windows of a shard are full but its last tokens, which are cut into powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import tokenizer
from .common import per_document, quoted, spread, stage

WINDOW, SHARD_TOKENS, K1, B = 1024, 1_000_000, 1.2, 0.75


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids, ascending, and their counts."""
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
    return s[first], np.diff(np.append(first, len(s)))


def weights(t: np.ndarray, tf: np.ndarray, length, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of terms that stand ``tf`` times in documents of ``length`` tokens."""
    return idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1.0)))


def strongest(t: np.ndarray, tf: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, idf: np.ndarray, df: np.ndarray, mean: float) -> np.ndarray:
    """The terms by which documents are dealt, the smallest of equals; -1 where a document shares none with another.

    ``t`` and ``tf`` are the documents' terms side by side, ``sizes`` how many each has.
    """
    out = np.full(len(sizes), -1, np.int64)
    held = np.flatnonzero(sizes)
    if len(held):
        w = np.where(df[t] > 1, weights(t, tf, np.repeat(lengths, sizes), idf, mean), 0.0)
        first = np.cumsum(sizes[held]) - sizes[held]
        top = np.maximum.reduceat(w, first)
        at = np.where(w == np.repeat(top, sizes[held]), np.arange(len(w)), len(w))
        best = np.minimum.reduceat(at, first)
        out[held] = np.where(top > 0, t[best], -1)
    return out


class Shard:
    """BM25 weights of one shard's documents, by document and by term.

    A seed is scored along the postings of its terms where these are few, else over all documents, of which used ones
    are dropped in time; so a seed that shares little costs little, however many documents a shard has.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        own = [_terms(ids[:-1]) for ids in docs]
        self.terms = [t for t, _ in own]
        size = np.array([len(t) for t in self.terms])
        self.held = np.flatnonzero(size)
        self.size = size[self.held]
        # terms keep their narrow type, which sorts fastest
        self.term = np.concatenate(self.terms)
        length = np.repeat([len(ids) - 1 for ids in docs], size)
        self.weight = weights(self.term, np.concatenate([n for _, n in own]), length, idf, mean)
        by = np.argsort(self.term, kind="stable")
        self.posted, self.posted_weight = np.repeat(np.arange(len(docs)), size)[by], self.weight[by]
        self.edge = np.concatenate(([0], np.cumsum(np.bincount(self.term, minlength=len(idf)))))
        # wide from here on: what is looked up for each seed
        self.term = self.term.astype(np.int64)
        self.asked = np.zeros(len(idf))
        self.first = np.cumsum(self.size) - self.size

    def scores(self, seed: int, unused: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unused documents, ascending, that share a term with the seed, and their BM25 for all of its terms."""
        terms = self.terms[seed].astype(np.int64)
        start, stop = self.edge[terms], self.edge[terms + 1]
        n = int((stop - start).sum())
        if 8 * n < len(self.term):
            at = np.repeat(start - np.cumsum(stop - start) + stop - start, stop - start) + np.arange(n)
            doc, weight = self.posted[at], self.posted_weight[at]
            left = unused[doc]
            found, number = np.unique(doc[left], return_inverse=True)
            return found, np.bincount(number, weight[left], len(found))
        left = unused[self.held]
        if 4 * np.count_nonzero(left) <= 3 * len(left):
            kept = np.repeat(left, self.size)
            self.term, self.weight, self.held, self.size = self.term[kept], self.weight[kept], self.held[left], self.size[left]
            self.first = np.cumsum(self.size) - self.size
            left = np.ones(len(self.held), bool)
        if not len(self.held):
            return self.held, np.zeros(0)
        self.asked[terms] = 1.0
        part = self.asked.take(self.term)
        part *= self.weight
        score = np.add.reduceat(part, self.first)
        self.asked[terms] = 0.0
        left &= score > 0
        return self.held[left], score[left]


def best(found: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` best-scored documents (or all), best first, of equals the first."""
    if len(found) > n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        above = np.flatnonzero(score > least)
        kept = np.sort(np.concatenate((above, np.flatnonzero(score == least)[: n - len(above)])))
        found, score = found[kept], score[kept]
    return found[np.argsort(-score, kind="stable")]


def packed(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each id of ``docs`` once."""
    index = Shard(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, filled, upcoming = 0, 0, 0

    def put(d: int, start: int) -> int:
        """Place what fits of a document from ``start``; the place reached."""
        nonlocal sequence, filled
        n = min(window - filled, len(docs[d]) - start)
        out.append((d, start, n, sequence, filled))
        filled += n
        if filled == window:
            sequence, filled = sequence + 1, 0
        return start + n

    carried: tuple[int, int] | None = None
    while True:
        if carried:
            seed, start = carried
        else:
            while upcoming < len(docs) and not unused[upcoming]:
                upcoming += 1
            if upcoming == len(docs):
                break
            seed, start = upcoming, 0
            unused[seed] = False
        carried = None
        while start < len(docs[seed]):
            start = put(seed, start)
        if not filled or not len(index.terms[seed]):
            continue
        # each document has an id at least, so no more than the open places are needed
        for d in best(*index.scores(seed, unused), window - filled).tolist():
            unused[d] = False
            if (reached := put(d, 0)) < len(docs[d]):
                carried = (d, reached)
            if not filled or carried:
                break
    # the open window: cut into sequences whose lengths are powers of two, the longest first
    last = []
    while out and out[-1][3] == sequence:
        last.append(out.pop())
    room = 0
    for d, start, n, _, _ in reversed(last):
        while n:
            if not room:
                size = room = 1 << (filled.bit_length() - 1)
            k = min(n, room)
            out.append((d, start, k, sequence, size - room))
            start, n, room, filled = start + k, n - k, room - k, filled - k
            sequence += not room
    return out


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a piece of a document.

    Null and empty texts are the end id alone. Repeated rows and null ids are documents of their
    own. Other columns are left out. ``sequence_id`` has the shard in its upper 32 bits. Documents without a term that
    another holds, empty ones among them, are dealt together.
    """
    spark = docs.sparkSession
    size = max(end_id + 1, tokenizer(tokenizer_path, pattern).library.get_vocab_size())
    width = "<u2" if size <= 1 << 16 else "<u4"

    def make():
        bpe = tokenizer(tokenizer_path, pattern)

        def work(texts):
            ids = [np.append(bpe.encode(t), np.uint32(end_id)).astype(width) for t in texts]
            own = [_terms(x[:-1]) for x in ids]
            return [[x.tobytes() for x in ids], [len(x) for x in ids], [t.tobytes() for t, _ in own], [n.astype("<u4").tobytes() for _, n in own]]

        return work

    def flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of a binary column side by side, and their sizes."""
        held = column.to_pylist()
        return np.frombuffer(b"".join(held), kind), np.array([len(x) // int(kind[-1]) for x in held], np.int64)

    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    tokens = stage(per_document(plain, ["id"], "ids binary, n long, terms binary, counts binary", make).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rows, total = tokens.agg(F.count("*"), F.sum("n")).first()

    def held(batches):
        """In how many documents each term occurs."""
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(flat(batch.column(0), width)[0], minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], ["term", "n"])

    def summed(frame: DataFrame, most: int) -> np.ndarray:
        """Totals by term: no more rows than the vocabulary has."""
        out = np.zeros(most, np.int64)
        for r in frame.groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r.term] = r.n
        return out

    df = summed(tokens.select("terms").mapInArrow(held, "term int, n long"), size)
    idf = np.log1p((rows - df + 0.5) / (df + 0.5))
    mean = ((total or 0) - rows) / max(1, rows)

    def terms_of(batch) -> np.ndarray:
        t, sizes = flat(batch.column(0), width)
        return strongest(t, flat(batch.column(1), "<u4")[0], sizes, batch.column(2).to_numpy() - 1, idf, df, mean)

    def by_term(batches):
        out = np.zeros(size + 1, np.int64)
        for batch in batches:
            np.add.at(out, terms_of(batch), batch.column(2).to_numpy())
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some], pa.int64())], ["term", "n"])

    # the last one: documents without a shared term
    lengths = summed(tokens.select("terms", "counts", "n").mapInArrow(by_term, "term int, n long"), size + 1)
    place = np.cumsum(lengths) - lengths

    def dealt(batches):
        for batch in batches:
            term = terms_of(batch)
            rows = batch.column(5).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at = place[term] + lengths[term] * ((rows >> np.uint64(11)) / float(1 << 53))
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), batch.column(5), pa.array((at // shard_tokens).astype(np.int64), pa.int64())], ["id", "ids", "row", "shard"])

    kind = plain.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields])
    types = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        ids, shard = table["id"].to_pylist(), table["shard"][0].as_py()
        held = [np.frombuffer(x, width) for x in table["ids"].to_pylist()]
        out = [(ids[d], s, n, zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()), len(held[d]), shard << 32 | q, o) for d, s, n, q, o in packed(held, idf, mean, window)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    placed = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("row", T.LongType()), T.StructField("shard", T.LongType())])
    shards = (total or 0) // shard_tokens + 1
    return spread(tokens.select("terms", "counts", "n", "id", "ids", "row").mapInArrow(dealt, placed), shards, "shard").groupBy("shard").applyInArrow(run, schema)
