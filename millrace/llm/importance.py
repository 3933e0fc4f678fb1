"""Importance resampling towards a target text by hashed word runs.

Features are all runs of 1 to ``n`` words. A document is scanned once: a ring holds the CRC-32 state of each of the last ``n``
starts; a word opens a start and extends the others by a space and itself, and every state is a feature's hash then. So a
feature costs one step of its own last word, whatever its length, and is never built as a string.

Bucket counts are summed where documents are read and meet as one row a bucket and task. A bucket's gain is the scaled
logarithm of its smoothed share in the target over that in the corpus; a document's weight is the sum of its features' gains.
With a Gumbel number drawn from its id's hash added, the highest scores are a draw without replacement in proportion
to the exponentials of the weights.
"""

from __future__ import annotations

import math
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import quoted, stage

RUN, BUCKETS, SEED, SCALE, PERCENT, LEAST_WORDS = 3, 10_000, 42, 1000, 5, 20
#: Words scanned before their hashes become an array; bounds a worker's memory on long texts.
PIECE = 1 << 15
#: Rows of a batch worked on at a time.
SLICE = 256

#: A-Z to a-z, other ASCII characters but letters and digits to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters, lower-cased in A-Z."""
    return text.translate(_PLAIN).split()


def buckets_of(words: list[bytes], n: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all runs of 1 to ``n`` consecutive words, repeats included."""
    ring: list[int] = []
    out = [np.zeros(0, np.uint32)]
    for at in range(0, len(words), PIECE):
        hashes: list[int] = []
        for w in words[at : at + PIECE]:
            more = b" " + w
            # the newest start first; the oldest of n falls out
            ring = [crc32(w), *[crc32(more, state) for state in ring[: n - 1]]]
            hashes += ring
        out.append(np.array(hashes, np.uint32) % np.uint32(buckets))
    return np.concatenate(out)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from its counts in the corpus and in the target."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: str, seed: int = SEED) -> int:
    """The scaled Gumbel number of a row's key."""
    h = int(sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def _scanned(rows: DataFrame, keep: list[str], text_col: str, n: int, buckets: int) -> DataFrame:
    """``keep`` and each text's number of words and buckets, the latter packed."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    kept = rows.select(*keep, F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([*kept.schema.fields[:-1], *T._parse_datatype_string("n_words long, buckets binary").fields])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sizes, packed = [], []
                for text in batch.column(len(keep)):
                    words = words_of(text.as_py())
                    sizes.append(len(words))
                    packed.append(buckets_of(words, n, buckets).astype(width).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], schema.names)

    return kept.mapInArrow(run, schema)


def _counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: a row a bucket and task is summed, a row a bucket collected."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                seen += np.bincount(np.frombuffer(packed.as_buffer(), width), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in scanned.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their ``place`` from 1 in a total order, without one task for all.

    Rows are dealt to partitions by ranges of the order and written; a partition's rows follow those of the partitions before.
    """
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the number has its partition in the upper bits and its place there in the lower 33
    placed = stage(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # as many rows as partitions
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "at", "before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, n: int = RUN, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row a document: the id, ``n_features``, ``weight``, ``score`` and ``rank``, null for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down. Null and
    empty texts have no words, weigh 0 and are not drawn, but have a score. Repeated rows are documents of their own: with one id they share
    their Gumbel number, and of equal scores and ids the heavier, then the longer comes first. A null id draws as the empty text and stands
    after others in ties. Empty tables count nothing: without documents there are no rows, without a target its shares are even. Other columns are
    left out.
    """
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))
    scanned = stage(_scanned(plain, ["id"], "t", n, buckets), "features")
    aimed = _counts(_scanned(target.select(F.col(quoted(target_col)).alias("t")), [], "t", n, buckets), buckets)
    gain = gains(_counts(scanned, buckets), aimed)
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("n_words long, n_features long, weight long, score long").fields])
    types = [to_arrow_type(f.dataType) for f in schema]

    def weigh(batches):
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), width) for x in batch.column(3)]
            weight = [int(gain[x].sum()) for x in held]
            score = [w + gumbel(key, seed) for w, key in zip(weight, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(types[0]), batch.column(2), *(pa.array(x, pa.int64()) for x in (map(len, held), weight, score))], schema.names)

    key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")
    weighed = stage(scanned.select("id", key, "n_words", "buckets").mapInArrow(weigh, schema), "weighed")
    long_enough = F.col("n_words") >= least_words
    drawn = percent * weighed.where(long_enough).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    placed = ranked(weighed.where(long_enough), order, "placed")
    out = placed.select("id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = weighed.where(~long_enough).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)
