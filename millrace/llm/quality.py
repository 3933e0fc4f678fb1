"""Quality rules: an isolation forest over rule statistics.

Each document gives the statistics of a few rules (share of symbols, of repeated words, of
repeated lines, ...). Each tree of the forest draws its own sub-sample, as the method has it, from all labelled rows; an anomaly is
isolated by few random splits. The score is ``2 ** (-mean path length / c(sample))``; the
threshold is the lowest that rejects at most ``loss`` of all labelled good rows, each scored by the trees alone that were
not grown from it. Rows that already fail the base rule take no part in either.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import number_of, numbered, per_document, quoted, stage

#: The trees of a forest, the rows that each is grown from, and the share of them that aren't good.
TREES, SAMPLE, STRAYS = 100, 512, 0.01
MIN_WORDS, MAX_REPEATED = 50, 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "digits", "punctuation", "bare_words", "single_characters", "top_word")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _repeated_words(found: list[bytes], window: int = 3) -> tuple[int, int]:
    """Words in windows found twice or more, and how often the commonest word stands."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in found], np.int64)
    n = len(ids) - window + 1
    most = int(np.bincount(ids).max()) if len(ids) else 0
    if n < 2:
        return 0, most
    code = ids[:n]
    for k in range(1, window):
        if k > 1:  # keeps the codes below the square of the text's length
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * len(names) + ids[k : n + k]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum()), most


def statistics(text: str) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rule statistics."""
    data = text.encode()
    found = data.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated_lines = len(lines) - len(set(lines))
    repeated, most = _repeated_words(found)
    sizes = list(map(len, found))
    n, letters = max(1, len(found)), max(1, chars)
    ascii_only = data.translate(None, b" \t\n\x0b\x0c\r")
    capitals = len(ascii_only) - len(ascii_only.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_only) - len(ascii_only.translate(None, b"0123456789"))
    marks = len(ascii_only) - len(ascii_only.translate(None, b"!?.,;:'\"()-_/=+@[]{}\\^~`"))
    bare = len(found) - len(data.translate(None, _MARKS).split())
    rates = [chars / n, symbols / n, repeated_lines / max(1, len(lines)), repeated / n, capitals / letters, digits / letters, marks / letters, bare / n, sizes.count(1) / n, most / n]
    return [len(found), chars, symbols, repeated_lines, repeated], rates


def base_failed(counts: list[int]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n``."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: feature (-1: leaf), cut, children, path length at a leaf.

    A tree's sample holds good rows and a share ``strays`` of others, so that what others have in common
    is rare in it and a cut can part them from the good rows.
    """

    def __init__(self, good: np.ndarray, others: np.ndarray, trees: int = TREES, sample: int = SAMPLE, strays: float = STRAYS, seed: int = 11):
        rng = np.random.default_rng(seed)
        n, m = shares(len(good), len(others), sample, strays)
        self.good, self.seen, drawn = good, np.zeros((trees, len(good)), bool), []
        for t in range(trees):
            at = rng.choice(len(good), n, replace=False)
            self.seen[t, at] = True
            drawn.append(np.concatenate((good[at], others[rng.choice(len(others), m, replace=False)])))
        self._plant(drawn, rng)

    @classmethod
    def of(cls, drawn: list[np.ndarray], seed: int = 11) -> Forest:
        """A tree from each of the samples."""
        made = cls.__new__(cls)
        made._plant(drawn, np.random.default_rng(seed))
        return made

    def _plant(self, drawn: list[np.ndarray], rng) -> None:
        self.sample = max(map(len, drawn))
        self.depth = max(1, math.ceil(math.log2(max(2, self.sample))))
        self.trees = [self._grow(rows, rng) for rows in drawn]

    def _grow(self, rows: np.ndarray, rng):
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _expected(len(part))])
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and len(wide):
                f = int(rng.choice(wide))
                cut = float(rng.uniform(low[f], high[f]))
                left = part[:, f] < cut
                nodes[at] = [f, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1), 0.0]
            return at

        grow(rows, 0)
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def _lengths(self, tree, rows: np.ndarray) -> np.ndarray:
        feature, cut, left, right, path = tree
        at, every = np.zeros(len(rows), int), np.arange(len(rows))
        for _ in range(self.depth):
            f = feature[at]
            go = np.where(rows[every, f] < cut[at], left[at], right[at])
            at = np.where(f < 0, at, go)
        return path[at]

    def _score(self, lengths: np.ndarray) -> np.ndarray:
        return 2.0 ** (-lengths / max(1.0, _expected(self.sample)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        return self._score(sum(self._lengths(t, rows) for t in self.trees) / len(self.trees))

    def unseen(self, rows: np.ndarray | None = None, seen: np.ndarray | None = None) -> np.ndarray:
        """Rows' scores, of each by the trees that were not grown from it (by all, where there are none).

        ``seen``: a row a tree, whether it was grown from each of the rows. Without arguments, the scores of the good rows that the forest was made of.
        """
        rows, seen = (self.good, self.seen) if rows is None else (rows, seen)
        total, n = np.zeros(len(rows)), np.zeros(len(rows))
        for tree, old in zip(self.trees, seen, strict=True):
            total[~old] += self._lengths(tree, rows[~old])
            n += ~old
        out, none = self._score(total / np.maximum(n, 1)), n == 0
        out[none] = self.scores(rows[none])
        return out


def shares(good: int, others: int, sample: int = SAMPLE, strays: float = STRAYS) -> tuple[int, int]:
    """How many good and other rows a tree is grown from. No tree sees all good rows, so that each row has trees that have not seen it."""
    m = min(others, max(1, round(sample * strays)))
    return min(sample - m, max(1, 2 * good // 3)), m


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lots(hashes: np.ndarray, tree: int) -> np.ndarray:
    """Each row's lot for a tree; the smallest are drawn."""
    return _mixed(hashes.astype(np.uint64) ^ _mixed(np.array([tree], np.uint64)))


def _rates(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _drawn(rows: DataFrame, chances: dict[bool, float]) -> DataFrame:
    """(tree, good, lot, rates): the rows whose lots are below the chance of their kind. ``rows``: h, good, rates."""

    def run(batches):
        for b in batches:
            h, good = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            chance = np.where(good, chances[True], chances[False])
            for t in range(TREES):
                lot = _lots(h, t)
                at = pa.array(np.flatnonzero(lot / 2.0**64 < chance))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), b.column(1).take(at), pa.array(lot[at.to_numpy()].view(np.int64)), b.column(2).take(at)], ["tree", "good", "lot", "rates"])

    return rows.mapInArrow(run, "tree int, good boolean, lot long, rates array<double>")


def _nth_largest(rows: DataFrame, name: str, n: int) -> float:
    """The value (from 0 to 1) that ``n`` rows stand before in falling order, found by its digits: counts leave the tasks, no rows."""
    rest = F.col(name)
    while True:
        rest = rest * 4096
        digit = F.floor(rest)
        for d, count, low, high in sorted(map(tuple, rows.groupBy(digit.alias("d")).agg(F.count("*"), F.min(name), F.max(name)).collect()), reverse=True):
            if n < count:
                break
            n -= count
        if low == high:
            return low
        rows, rest = rows.where(digit == d), rest - digit


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", loss: float = 0.005):
    """The forest and its threshold from all labelled rows; None where no good ones are labelled."""
    return _fitted(stage(_measured(docs, id_col, text_col), "statistics"), labels, id_col, label_col, loss)


def _fitted(found: DataFrame, labels: DataFrame, id_col: str, label_col: str = "quality", loss: float = 0.005):
    """From documents' statistics: rows are few numbers wide, and only the trees' samples come to the driver."""
    marked = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label")).dropna()
    marked = marked.groupBy("id").agg(F.min("label").alias("label"))
    passed = found.where("not base_failed").select(F.col(ID).alias("id"), RATES)
    rows = stage(passed.join(marked, "id").select(F.xxhash64("id").alias("h"), (F.col("label") == 1).alias("good"), F.col(RATES).alias("rates")), "labelled")
    count = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    if not count.get(True):
        return None
    want = dict(zip((True, False), shares(count[True], count.get(False, 0)), strict=True))
    # some more than are wanted; the smallest lots stay
    chances = {k: min(1.0, (n + 6 * math.sqrt(n) + 20) / max(1, count.get(k, 0))) for k, n in want.items()}
    table = _drawn(rows, chances).toArrow().combine_chunks()
    tree, good, lot = (table.column(c).to_numpy() for c in ("tree", "good", "lot"))
    lot, rates = lot.view(np.uint64), _rates(table.column("rates").combine_chunks())
    order = np.lexsort((*rates.T, lot, ~good, tree))
    samples, last = [], np.zeros(TREES, np.uint64)
    for t in range(TREES):
        mine = order[np.searchsorted(tree[order], t) : np.searchsorted(tree[order], t, "right")]
        fine = mine[good[mine]][: want[True]]
        last[t] = lot[fine[-1]]
        samples.append(rates[np.concatenate((fine, mine[~good[mine]][: want[False]]))])
    forest = Forest.of(samples)

    def calm(batches):
        for b in batches:
            h = b.column(0).to_numpy()
            seen = np.array([_lots(h, t) <= last[t] for t in range(TREES)])
            yield pa.RecordBatch.from_arrays([pa.array(forest.unseen(_rates(b.column(1)), seen))], ["score"])

    scores = stage(rows.where("good").select("h", "rates").mapInArrow(calm, "score double"), "calm")
    return forest, _nth_largest(scores, "score", min(count[True] - 1, int(loss * count[True]))) + 1e-9


#: A document's id and rates beside its counts.
ID, RATES = "__id", "__rates"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids with the base counts, ``base_failed`` and the rates."""

    def work(texts):
        found = [statistics(t) for t in texts]
        return [*([c[i] for c, _ in found] for i in range(5)), [base_failed(c) for c, _ in found], [r for _, r in found]]

    named = docs.select(F.col(quoted(id_col)).alias(ID), F.col(quoted(text_col)).alias("text"))
    return per_document(named, [ID], f"{COUNTS}, {RATES} array<double>", lambda: work)


def _verdict(model, failed: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anomaly, and whether a document is kept."""
    score = model[0].scores(rates) if model else np.zeros(len(failed))
    return score, ~failed & (score <= model[1] if model else True)


def judged(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with the base counts, ``base_failed``, ``anomaly`` and ``kept``."""

    def work(texts):
        found = [statistics(t) for t in texts]
        failed = np.array([base_failed(c) for c, _ in found], bool)
        score, kept = _verdict(model, failed, np.array([r for _, r in found]))
        return [*([c[i] for c, _ in found] for i in range(5)), failed, score, kept]

    return per_document(docs, keep, f"{COUNTS}, anomaly double, kept boolean", lambda: work, text_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with the rules' counts and the forest's verdict.

    Null and empty texts have no words and fail the base rule. Without labelled good rows only
    the base rule decides. Repeated rows stay; other columns are left out; a label that is
    given twice for an id counts once, as the lower of the two.
    """
    found = stage(_measured(docs, id_col, text_col), "statistics")
    model = _fitted(found, labels, id_col)
    body = [c for c in found.columns if c != RATES]
    schema = T.StructType([*(found.schema[c] for c in body), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for b in batches:
            score, kept = _verdict(model, b.column("base_failed").to_numpy(zero_copy_only=False).astype(bool), _rates(b.column(RATES)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in body), pa.array(score), pa.array(kept)], schema.names)

    out = found.mapInArrow(run, schema)
    # an id named like a count gives way to it
    return out.drop(ID) if id_col.lower() in {c.lower() for c in out.columns} else out.withColumnRenamed(ID, id_col)


def passed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns and rows of ``docs`` that the base rule and the forest keep.

    Null and empty texts fail the base rule and go; repeated rows with one text share their fate; columns keep their values
    whatever their names.
    """
    model = fit(docs, labels, id_col, text_col)
    plain = numbered(docs)
    return judged(plain, model, plain.columns, number_of(docs, text_col)).where("kept").select(*plain.columns).toDF(*docs.columns)
