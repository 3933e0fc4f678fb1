"""Katz backoff language model whose n-gram counts cover the whole training corpus.

Seen n-grams get Good-Turing discounted shares ``d(c) c / C(h)``, others ``weight(h)`` times the
shorter n-gram's probability; ``weight(h)`` is such that the probabilities after each history sum to
one exactly. Words outside the training vocabulary share what the discounts leave over of the unigrams.

Texts are turned into blocks of word numbers. A block asks for each n-gram in it once: its keys
(64-bit hashes) and local counts go to the key's shard, which sums them and answers each block in
the order of its keys; the answers are written tables, by order and shard. With ``tables`` the shards' own
parts of the model (keys with counts, histories with the sums behind their weights) are kept too. So each exchange moves one entry
a block and n-gram however often the n-gram occurs, no history or word is gathered in one place (a
key has one entry a block), and shards and blocks stay of bounded size as the corpus grows. The
backoff weights of each order take one more such exchange: of the blocks that hold an n-gram the
first adds its shares to the sums of its history.

Keys are hashes: two of a billion n-grams share one with a chance of a few in a hundred, and then
count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE, TEXT, fold_of, quoted, spread, stage, with_text

ORDER, FOLDS, GOOD_TURING = 2, 10, 5
BLOCK_TOKENS, SHARD_TOKENS = 1_500_000, 3_000_000
END, BEGIN = 0, 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M1) ^ (b + _M2 + (a << np.uint64(7)))
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


_END_KEY, _BEGIN_KEY = np.uint64(xxhash.xxh64_intdigest(b"\n end")), np.uint64(xxhash.xxh64_intdigest(b"\n begin"))


def _packed(a: np.ndarray) -> bytes:
    """Compressed, the values' first bytes together, then their second ones, and so on."""
    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def begin_keys(order: int) -> list[int]:
    """The keys of the histories made of begin marks alone, by length."""
    out = [np.array([_BEGIN_KEY])]
    for _ in range(order - 1):
        out.append(_mixed(out[-1], out[0]))
    return [int(x[0]) for x in out]


def lowered(text: str) -> list[bytes]:
    return text.encode().lower().split()


def blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, order: int, size: int) -> DataFrame:
    """Texts as blocks: ids, marks of the training rows, lengths, word numbers, and the words' keys."""
    kind = docs.schema[id_col].dataType
    source = with_text(docs.withColumn("__train", fold_of(id_col, folds) != 0), [id_col, "__train"], text_col)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("train", "lengths", "words", "keys"))])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        made = TaskContext.get().partitionId() << 32
        ids, train, lengths, parts, names, n = [], [], [], [], {}, 0

        def row():
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
            keys = np.concatenate((np.array([_END_KEY, _BEGIN_KEY]), keys))
            data = [np.array(train, bool).tobytes(), np.array(lengths, np.int32).tobytes(), _packed(np.concatenate(parts)), keys.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[made], [sum(lengths)], [ids], *([x] for x in data)], types, strict=True)], schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for i, t, text in zip(*(c.to_pylist() for c in whole.slice(at, SLICE).columns), strict=True):
                    found = lowered(text)
                    ids.append(i)
                    train.append(t)
                    lengths.append(len(found) + 1)
                    parts.append(np.array([BEGIN] * (order - 1) + [names.setdefault(w, len(names) + 2) for w in found] + [END], np.int32))
                    n += len(found) + 1
                    if n >= size:
                        yield row()
                        made += 1
                        ids, train, lengths, parts, names, n = [], [], [], [], {}, 0
        if ids:
            yield row()

    return source.select(quoted(id_col), "__train", TEXT).mapInArrow(run, schema)


class Block:
    """A block's n-grams: for each order the number at every place, and of each number its key, history, suffix and training count."""

    def __init__(self, row: dict, order: int):
        self.train = np.frombuffer(row["train"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        words = _unpacked(row["words"], np.int32).astype(np.int64)
        padded = self.lengths.astype(np.int64) + order - 1
        first = np.concatenate(([0], np.cumsum(padded)[:-1]))
        self.doc = np.repeat(np.arange(len(padded)), padded)
        before = np.arange(len(words)) - 1
        before[first] = first
        self.place = np.flatnonzero(np.arange(len(words)) - first[self.doc] >= order - 1)
        counted = self.train[self.doc].copy()
        word_keys = np.frombuffer(row["keys"], np.uint64)
        begins = np.zeros(len(words), bool)
        if order > 1:
            for k in range(order - 1):
                begins[first + k] = True
        else:
            begins[:] = False
        # a begin mark is counted once a text, as the history of its first word
        tally = counted & ~begins
        if order > 1:
            tally[first + order - 2] = self.train
        self.at = [words]
        self.keys = [word_keys]
        self.history, self.suffix, self.begins = [None], [None], [None]
        self.count = [np.bincount(words, tally, len(word_keys)).astype(np.int64)]
        for _ in range(order - 1):
            low = self.at[-1]
            code = low[before] * len(word_keys) + words
            _, where, number = np.unique(code, return_index=True, return_inverse=True)
            self.history.append(low[before[where]])
            self.suffix.append(low[where])
            self.begins.append(words[where] == BEGIN)
            self.keys.append(_mixed(self.keys[-1][self.history[-1]], word_keys[words[where]]))
            self.at.append(number)
            self.count.append(np.bincount(number, tally, len(where)).astype(np.int64))


def _shards(keys: np.ndarray, n: int):
    """For each shard its keys' places, ascending."""
    shard = (keys >> np.uint64(20)) % np.uint64(n)
    by = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[by], np.arange(n + 1, dtype=np.uint64))
    return [by[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_HEAD = T.StructType().add("shard", T.IntegerType()).add("block", T.LongType()).add("k", T.IntegerType())
_DATA = [T.StructField(c, T.BinaryType()) for c in ("keys", "x", "y")]
ASKED = T.StructType([*_HEAD.fields, *_DATA])
TOLD = T.StructType([*_HEAD.fields, *_DATA[1:], T.StructField("stats", T.ArrayType(T.DoubleType()))])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], schema.names)


def _counts(table: pa.Table, order: int, most: int, keep: bool = False) -> pa.Table:
    """A shard's answer to the blocks' counts: totals, and a mark for the first block that trains on the n-gram."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["k"], r["block"]))
    out, begin = [], begin_keys(order)
    for k in sorted({r["k"] for r in rows}):
        own = [r for r in rows if r["k"] == k]
        keys = [np.frombuffer(r["keys"], np.uint64) for r in own]
        mine = np.concatenate([_unpacked(r["x"], np.uint32) for r in own]).astype(np.int64)
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, mine, len(distinct)).astype(np.int64)
        owner = np.full(len(distinct), len(number))
        trained = np.flatnonzero(mine)
        np.minimum.at(owner, number[trained], trained)
        answer = total[number]
        first = owner[number] == np.arange(len(number))
        at = 0
        for r, x in zip(own, keys, strict=True):
            out.append((r["shard"], r["block"], k, _packed(answer[at : at + len(x)].astype(np.uint32)), np.packbits(first[at : at + len(x)]).tobytes(), None))
            at += len(x)
        real = total[(total > 0) & (distinct != np.uint64(begin[k - 1]))]
        held = (distinct[total > 0].tobytes(), _packed(total[total > 0])) if keep else (None, None)
        out.append((own[0]["shard"], -1, k, *held, [float(real.sum()), float(len(real)), *np.bincount(np.minimum(real, most + 2), minlength=most + 3)[1 : most + 2].astype(float)]))
    return pa.Table.from_batches([_batch(out, TOLD)])


def _sums(table: pa.Table, keep: bool = False) -> pa.Table:
    """A shard's answer to the blocks' parts of the histories' sums."""
    own = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [np.frombuffer(r["keys"], np.uint64) for r in own]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = [np.bincount(number, np.concatenate([_unpacked(r[c], np.float64) for r in own]), len(distinct)) for c in ("x", "y")]
    sums = [t[number] for t in total]
    out, at = [], 0
    if keep:
        out.append((own[0]["shard"], -1, own[0]["k"], distinct.tobytes(), _packed(np.concatenate(total)), None))
    for r, x in zip(own, keys, strict=True):
        out.append((r["shard"], r["block"], r["k"], _packed(sums[0][at : at + len(x)]), _packed(sums[1][at : at + len(x)]), None))
        at += len(x)
    return pa.Table.from_batches([_batch(out, TOLD)])


def discounts(stats: list[float], most: int) -> np.ndarray:
    """Katz's Good-Turing discounts d(1..most); where they aren't between 0 and 1, ``(c - 0.5) / c``."""
    n = [0.0, *stats[2:]]
    plain = np.array([(c - 0.5) / c for c in range(1, most + 1)])
    if not all(n[1 : most + 2]):
        return plain
    beyond = (most + 1) * n[most + 1] / n[1]
    if beyond >= 1:
        return plain
    d = np.array([((c + 1) * n[c + 1] / (c * n[c]) - beyond) / (1 - beyond) for c in range(1, most + 1)])
    return d if (d > 0).all() and (d < 1).all() else plain


class Model:
    """The small part of the model: counts of counts and discounts by order."""

    def __init__(self, stats: dict[int, list[float]], order: int, most: int):
        empty = [0.0] * (most + 3)
        self.order, self.most = order, most
        self.total, self.words = (int(x) for x in stats.get(1, empty)[:2])
        self.d = [discounts(stats.get(k, empty), most) for k in range(1, order + 1)]
        held = np.array(stats.get(1, empty)[2 : 2 + most])
        c = np.arange(1, most + 1)
        left = float((held * c * (1 - self.d[0])).sum()) / self.total if self.total else 1.0
        #: Without rare words the discounts leave nothing; then one count is set aside.
        self.scale = 1.0 if left > 0 else self.total / (self.total + 1)
        self.unknown = left if left > 0 else 1 / (self.total + 1)

    def share(self, k: int, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        """d(c) c / C, 0 for unseen n-grams."""
        d = np.concatenate(([0.0], self.d[k - 1], [1.0]))[np.minimum(count, self.most + 1)]
        return np.where(count > 0, d * count / np.maximum(of, 1), 0.0)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.share(1, count, np.array(self.total)) * self.scale, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.words + 1)))


def _gathered(table: pa.Table, order: int, shards: int):
    """A block's row, its n-grams, and by (order, answer) what the shards answered, by n-gram number."""
    rows = table.to_pylist()
    block = next(r for r in rows if r["ids"] is not None)
    grams = Block(block, order)
    places: dict[int, list[np.ndarray]] = {}
    count, first, sums = {}, {}, {}
    for r in rows:
        if r["ids"] is not None:
            continue
        k, size = abs(r["k"]), None
        if k not in places:
            places[k] = _shards(grams.keys[k - 1], shards)
        where = places[k][r["shard"]]
        size = len(grams.keys[k - 1])
        if r["k"] > 0:
            count.setdefault(k, np.zeros(size, np.int64))[where] = _unpacked(r["x"], np.uint32)
            first.setdefault(k, np.zeros(size, bool))[where] = np.unpackbits(np.frombuffer(r["y"], np.uint8), count=len(where)).astype(bool)
        else:
            seen, low = sums.setdefault(k, (np.zeros(size), np.zeros(size)))
            seen[where] = _unpacked(r["x"], np.float64)
            low[where] = _unpacked(r["y"], np.float64)
    return block, grams, count, first, sums


def _probabilities(model: Model, grams: Block, count, sums, upto: int) -> np.ndarray:
    """Of each n-gram of order ``upto`` in the block, recursively from the shorter ones."""
    if upto == 1:
        return model.unigram(count[1])
    low = _probabilities(model, grams, count, sums, upto - 1)[grams.suffix[upto - 1]]
    history = grams.history[upto - 1]
    of = count[upto - 1][history]
    seen, lower = (x[history] for x in sums[upto - 1])
    # where no discount leaves anything, one count is set aside for unseen words
    scale = np.where(seen < 1 - 1e-12, 1.0, of / (of + 1.0))
    weight = np.where(of > 0, (1 - scale * seen) / np.maximum(1 - lower, 1e-300), 1.0)
    share = model.share(upto, count[upto], of)
    return np.where(count[upto] > 0, scale * share, weight * low)


def _asked(number: int, k: int, keys: np.ndarray, shards: int, *values: np.ndarray) -> list[tuple]:
    return [(s, number, k, keys[w].tobytes(), *(_packed(v[w]) for v in values), *[None] * (2 - len(values))) for s, w in enumerate(_shards(keys, shards)) if len(w)]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, tables: str | None = None) -> DataFrame:
    """One row a document with its unigram ``base_score`` and its Katz ``score``, both log10.

    Learns from the rows whose crc32 of the id modulo ``folds`` is not 0 (a null id counts as the
    empty text and is held out). Null and empty texts are the end token alone. Repeated rows
    stay and are learned from as often. Without training rows every token is unknown. Other
    columns are left out. ``tables`` names a folder for the model: rows by order ``k`` (for sums, minus the
    history's length) and shard with packed keys (``x``) and counts or sums (``y``).
    """
    spark, most = docs.sparkSession, GOOD_TURING
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    made = stage(blocks(plain, "id", "text", folds, order, block_tokens), "blocks", rows_per_file=1)
    tokens, n_blocks = made.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-order * tokens // shard_tokens))

    def count_requests(batches):
        for batch in batches:
            for r in batch.to_pylist():
                grams = Block(r, order)
                for k in range(1, order + 1):
                    yield _batch(_asked(r["block"], k, grams.keys[k - 1], shards, grams.count[k - 1].astype(np.uint32)), ASKED)

    told = stage(spread(made.mapInArrow(count_requests, ASKED), shards, "shard").groupBy("shard").applyInArrow(lambda t: _counts(t, order, most, bool(tables)), TOLD), "counts")
    stats = told.where("block = -1").select("k", F.posexplode("stats")).groupBy("k", "pos").agg(F.sum("col").alias("n")).collect()
    by_order: dict[int, list[float]] = {}
    for r in sorted(stats, key=lambda r: (r.k, r.pos)):
        by_order.setdefault(r.k, []).append(r.n)
    model = Model(by_order, order, most)

    def kept(answers: DataFrame, mode: str) -> None:
        if tables:
            answers.where("block = -1").select("k", "shard", "x", "y").write.mode(mode).partitionBy("k").parquet(tables)

    kept(told, "errorifexists")
    told = told.where("block >= 0").drop("stats")

    def gathered(answers: DataFrame):
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema if f.name != "block"]
        rows = made.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("k", "int"), ("x", "binary"), ("y", "binary"))))
        return spread(rows.unionByName(answers.select("block", *empty, "shard", "k", "x", "y")), n_blocks, "block").groupBy("block")

    def sum_requests(k: int):
        def run(table: pa.Table) -> pa.Table:
            block, grams, count, first, sums = _gathered(table, order, shards)
            history = grams.history[k - 1]
            own = first[k] & ~grams.begins[k - 1]
            share = np.where(own, model.share(k, count[k], count[k - 1][history]), 0.0)
            low = np.where(own, _probabilities(model, grams, count, sums, k - 1)[grams.suffix[k - 1]], 0.0)
            n = len(grams.keys[k - 2])
            return pa.Table.from_batches([_batch(_asked(block["block"], 1 - k, grams.keys[k - 2], shards, np.bincount(history, share, n), np.bincount(history, low, n)), ASKED)])

        return run

    for k in range(2, order + 1):
        answers = stage(spread(gathered(told).applyInArrow(sum_requests(k), ASKED), shards, "shard").groupBy("shard").applyInArrow(lambda t: _sums(t, bool(tables)), TOLD), "sums")
        kept(answers, "append")
        told = told.unionByName(answers.where("block >= 0").drop("stats"))

    kind = docs.schema[[c.lower() for c in docs.columns].index(id_col.lower())].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    types = [to_arrow_type(f.dataType) for f in schema]

    def final(table: pa.Table) -> pa.Table:
        block, grams, count, _, sums = _gathered(table, order, shards)
        doc, n = grams.doc[grams.place], len(grams.lengths)
        words = grams.at[0][grams.place]
        total = np.bincount(doc, np.log10(_probabilities(model, grams, count, sums, order)[grams.at[-1][grams.place]]), n)
        base = np.bincount(doc, model.base(count[1])[words], n)
        known = np.bincount(doc, count[1][words] > 0, n).astype(np.int64)
        columns = [block["ids"], ~grams.train, grams.lengths, known, [model.total] * n, base, total]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return gathered(told).applyInArrow(final, schema)
