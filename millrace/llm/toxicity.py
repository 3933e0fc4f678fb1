"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the words in it and of their beginnings;
a document's is the noisy-or ``1 - prod(1 - p)``. Weights are learned from document labels
alone (proximal Adam with an L1 penalty, which keeps few words), on a bounded sample of
labelled rows, whose features are made by the executors as hashes. The sentences with a probability of a half or more locate the offence.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, number_of, numbered, per_document, quoted, stage

#: Most labelled rows that the weights are fitted on, by order of a hash of their id, and most features in them all together.
LABELLED, FEATURES = 4000, 20_000_000
FOLDS = 5
#: Features that are looked up at a time.
BLOCK = 1 << 18
#: Lengths of the beginnings of words that are features too, for words never seen whole.
BEGINNINGS = (4, 5)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str):
    """(start, end, features) of each sentence with a word: its lower-cased words and their beginnings."""
    for m in _SENTENCE.finditer(text):
        if found := set(_WORD.findall(m[0].lower())):
            for n in BEGINNINGS:
                found |= {w[:n] + "*" for w in found if len(w) > n and w[-1] != "*"}
            yield m.start(), m.end(), found


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and its offending sentences; 0 without a sentence."""
        clear, where, n = 0.0, [], 0
        get, known, quiet = self.weights.get, self.weights.keys(), -math.log1p(math.exp(self.bias))
        for start, end, found in sentences(text):
            if hits := known & found:
                z = self.bias + math.fsum(map(get, hits))
                clear -= math.log1p(math.exp(min(z, 30.0)))
                if z >= 0:
                    where.append((start, end, 1 / (1 + math.exp(-z))))
            else:
                n += 1
        return -math.expm1(clear + n * quiet), where


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features' hashes, sentence by sentence, and the sentences' numbers of features."""
    names, sizes = [], []
    for _, _, found in sentences(text):
        names += found
        sizes.append(len(found))
    known: dict[str, int] = {}
    own = [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in names]
    return np.array(own, np.uint64), np.array(sizes, np.int32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], least: int = 3, steps: int = 200, rate: float = 0.1, penalty: float = 4e-4, settled: float = 2e-4) -> tuple[dict[int, float], float]:
    """Weights by hash, and the bias, from (hashes, sizes of sentences, label) of documents.

    Features of fewer than ``least`` documents are left out. It ends when ten steps lower the loss by a share of less than ``settled``.
    """
    y = np.array([label for _, _, label in rows], float)
    if not 0 < y.sum() < len(y):
        return {}, -30.0 if not y.sum() else 0.0
    # narrow numbers and no array of pairs: this stands in the driver's memory
    every = np.concatenate([h for h, _, _ in rows])
    names = np.unique(every)
    each = np.empty(len(every), np.int32)
    for at in range(0, len(every), BLOCK):
        each[at : at + BLOCK] = np.searchsorted(names, every[at : at + BLOCK])
    del every
    of, edges = np.zeros(len(names), np.int32), np.cumsum([0, *(len(h) for h, _, _ in rows)])
    for start, end in zip(edges, edges[1:]):
        of[np.unique(each[start:end])] += 1
    held = of >= least
    names, number = names[held], (np.cumsum(held) - 1).astype(np.int32)
    sizes = np.concatenate([s for _, s, _ in rows])
    sd = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for _, s, _ in rows])
    kept = held[each]
    ew, es = number[each[kept]], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept]
    del each, kept
    if not len(names):
        return {}, 0.0
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = np.zeros(len(names)), -5.0
    mom, var, losses = np.zeros(len(names) + 1), np.zeros(len(names) + 1), []
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(es, w[ew], len(sd)), -30, 30)))
        clear = np.bincount(sd, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        bag = np.clip(-np.expm1(clear), 1e-9, 1 - 1e-9)
        losses.append(float(-(weight * (y * np.log(bag) + (1 - y) * np.log1p(-bag))).mean() + penalty * np.abs(w).sum()))
        if step > 40 and losses[-11] - losses[-1] < settled * losses[-1]:
            break
        # d loss / d z of a sentence: -(y/P - (1-y)/(1-P)) (1-P) p
        slope = (weight * ((1 - y) - y * (1 - bag) / bag))[sd] * p / len(y)
        grad = np.append(np.bincount(ew, slope[es], len(names)), slope.sum())
        mom += 0.1 * (grad - mom)
        var += 0.01 * (grad * grad - var)
        move = rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
        w, b = w - move[:-1], b - move[-1]
        shrink = rate * penalty / (np.sqrt(var[:-1] / (1 - 0.99**step)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    return {int(names[i]): float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED, features: int = FEATURES) -> Model:
    """A model from at most ``most`` labelled rows outside fold 0 (crc32 of the id modulo 5).

    Rows are taken in order of a hash of their id as long as they have ``features`` features or fewer all together.
    """
    marked = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label")).dropna()
    chosen = marked.where(fold_of("id", FOLDS) != 0).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    found = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).dropna().join(F.broadcast(chosen), "id")
    found = stage(found.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id", "h").limit(most), "labelled")

    def make():
        return lambda texts: [list(c) for c in zip(*((h.tobytes(), s.tobytes(), len(h)) for h, s in map(hashed, texts)))] or [[], [], []]

    packed = stage(per_document(found, ["id", "h", "label"], "hashes binary, sizes binary, n long", make), "features")
    sized = sorted(packed.select(F.xxhash64("id").alias("o"), "id", "h", "n").collect())
    fits = int(np.searchsorted(np.cumsum([r.n for r in sized]), features, "right")) if sized else 0
    if not fits:
        return Model({}, -30.0)
    last = sized[fits - 1]
    order = F.struct(F.xxhash64("id").alias("o"), "id", "h")
    rows = packed.where(order <= F.struct(F.lit(last.o).alias("o"), F.lit(last.id).alias("id"), F.lit(last.h).alias("h"))).orderBy(order).select("hashes", "sizes", "label").toArrow()
    weights, bias = train([(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(s.as_buffer(), np.int32), int(y.as_py())) for h, s, y in zip(*rows.columns, strict=True)])

    def names():
        return lambda texts: [[sorted(w for w in set().union(*(x for _, _, x in sentences(t))) if xxhash.xxh64_intdigest(w) in weights) for t in texts]]

    # the names of the features that have a weight: no more than there are weights
    named = per_document(found, [], "names array<string>", names).select(F.explode("names").alias("w")).distinct().collect() if weights else []
    return Model({r.w: weights[xxhash.xxh64_intdigest(r.w)] for r in named}, bias)


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with ``score``, ``predicted``, and the offending sentences as ``start:end`` joined by commas."""

    def make():
        def work(texts):
            found = [model.score(t) for t in texts]
            return [[s for s, _ in found], [int(s >= 0.5) for s, _ in found], [",".join(f"{a}:{b}" for a, b, _ in x) for _, x in found]]

        return work

    return per_document(docs, keep, "score double, predicted int, offending string", make, text_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``held_out``, ``score``, ``predicted``, ``offending``.

    Null and empty texts have no sentence and score 0. Null ids count as held out and are never
    learned from. Without labels of both kinds every text with sentences gets one constant score. Repeated rows stay;
    other columns are left out.
    """
    model = fit(docs, labels, id_col, text_col)
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), (fold_of(id_col, FOLDS) == 0).alias("held"))
    out = scored(plain, model, ["id", "held"])
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "score", "predicted", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns and rows of ``docs`` but those predicted toxic.

    Null and empty texts stay, as do repeated rows with the same verdict; columns keep their values whatever their names.
    """
    model = fit(docs, labels, id_col, text_col)
    plain = numbered(docs)
    return scored(plain, model, plain.columns, number_of(docs, text_col)).where("predicted = 0").select(*plain.columns).toDF(*docs.columns)
