"""Importance resampling against a version that builds every feature as text."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm.importance import buckets_of, resample, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_buckets(text, n=3, buckets=10_000):
    w = plain_words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=5, least=20):
    held = [plain_buckets(t) for _, t in rows]
    s, t = Counter(x for h in held for x in h), Counter(x for r in target for x in plain_buckets(r))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        weight = sum(map(gain, h))
        u = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(plain_words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], -r[2], -r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(frame):
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_corpus(spark, corpus):
    target = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert got(resample(corpus, target)) == plain(rows, [r.text for r in target.collect()])


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = ["the cat sat", None, "", "naïve CAFÉ 日本語", "the cat sat"]
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample(odd, aimed, percent=100)) == plain(rows, target, percent=100)
    assert got(resample(odd, aimed, percent=100, least_words=0)) == plain(rows, target, percent=100, least=0)
    assert resample(none, aimed).collect() == []
    assert got(resample(odd, none, percent=50)) == plain(rows, [], percent=50)


def test_ties_and_repeats(spark):
    """Copies with one id tie; the whole order is still 1, 2, 3, ..."""
    text = "alpha beta gamma " * 8
    rows = [(i % 7, text if i % 3 else text + "delta") for i in range(90)] + [(None, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    aimed = spark.createDataFrame([(text,)], "text string")
    for percent in (5, 50, 100):
        out = got(resample(frame, aimed, percent=percent))
        assert out == plain(rows, [text], percent=percent)
        assert sorted(r[4] for r in out if r[4]) == list(range(1, percent * 91 // 100 + 1))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ring_of_any_length(corpus, n):
    for r in corpus.limit(20).collect():
        assert sorted(buckets_of(words_of(r.text.encode()), n, 997).tolist()) == sorted(plain_buckets(r.text, n, 997))


def test_long_text(spark):
    """Pieces of a long text join without a seam."""
    text = "".join(f"w{i % 1013} x{i % 7}," for i in range(150_000))
    row = resample(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=100).first()
    assert (row.n_features, row["rank"]) == (3 * 300_000 - 3, 1)
    assert sorted(buckets_of(words_of(text.encode())).tolist()) == sorted(plain_buckets(text))


def test_other_columns_do_not_clash(spark):
    frame = spark.createDataFrame([("a", 1, "x y", 2.0)], "RANK string, doc_id int, text string, weight double")
    assert resample(frame, frame).select(F.count("*")).first()[0] == 1
