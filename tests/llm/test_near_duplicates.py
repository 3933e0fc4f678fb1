"""SimHash and embedding near-duplicates, components, and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm.caps import near_duplicates as near_vectors
from millrace.llm.common import components
from millrace.llm.simhash import deduplicated, fingerprint, near_duplicates, signed


def plain_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd, corpus):
    for r in [*odd.collect(), *corpus.limit(50).collect()]:
        assert fingerprint(r.text or "") == plain_fingerprint(r.text)


@pytest.mark.parametrize("dense", [4096, 3])
def test_components_of_fingerprints(spark, monkeypatch, dense):
    import millrace.llm.simhash as S

    rng = random.Random(7)
    values = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(40):
        x = rng.getrandbits(64)
        values.append(x)
        for _ in range(rng.choice([0, 1, 12])):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            values.append(y)
    values = sorted({signed(v) for v in values})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    linked = [(i, j) for i in range(len(values)) for j in range(i) if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= 4]
    want = plain_components(len(values), linked)
    found = {r.node: r.component for r in components(S.links(frame, dense=dense)).collect()}
    got = [found.get(v, v) for v in values]
    assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))
    if dense == 4096:
        pairs = [(r.a, r.b) for r in S.links(frame).collect()]
        assert len(pairs) == len(set(pairs)) == len(linked)


@pytest.mark.parametrize("groups", [10, 12, 16])
def test_pairs_are_the_same_with_any_number_of_groups(spark, groups):
    import millrace.llm.simhash as S

    rng = random.Random(groups)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        values.add(x)
        for n in (1, 2, 3, 4, 4, 5):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    values = sorted(map(signed, values))
    want = sorted((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    assert sorted((r.a, r.b) for r in S.links(frame, groups=groups).collect()) == want


def test_grids_follow_the_number_of_fingerprints():
    import millrace.llm.simhash as S

    assert len(S.grids_of(8)) == 70 and [S.groups_for(n) for n in (0, 10**6, 10**8, 10**9, 10**10)] == [8, 8, 8, 10, 12]
    for groups in S.GROUPS:
        masks = S._masks(groups)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == groups
        # four changed groups at most leave a grid untouched
        assert all(any(not m & sum(masks[g] for g in c) for m, _ in S.grids_of(groups)) for c in list(combinations(range(groups), 4))[::37])


def test_near_duplicate_documents(odd, corpus, none):
    docs = odd.select("doc_id", "text").where("doc_id is not null").unionByName(corpus.select("doc_id", "text").where("doc_id >= 100"))
    rows = docs.collect()
    prints = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    root = plain_components(len(rows), [(int(i), int(j)) for i, j in zip(*np.nonzero(close)) if i > j])
    least = {}
    for r, c in zip(rows, root, strict=True):
        least[c] = min(r.doc_id, least.get(c, r.doc_id))
    want = sorted((r.doc_id, f"{int(p):016x}", least[c]) for r, p, c in zip(rows, prints, root, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()) == want
    kept = deduplicated(docs.withColumn("fp", F.lit("clash")).withColumn("ROW", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp", "ROW"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert near_duplicates(odd).count() == odd.count()
    assert near_duplicates(none).count() == 0 and deduplicated(none).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 4), (9, 8), (8, 4), (20, 21), (20, 21)]])
def test_components(spark, edges):
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = plain_components(60, edges)
    assert found == {n: root[n] for n in {x for e in edges for x in e if e[0] != e[1]}}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        centre = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((centre + 0.3 * rng.standard_normal(64) * rng.random()).tolist())
    rows += [rows[0], rows[0], [0.0] * 64, None, [], [float("nan")] * 64, [float("inf"), *[1.0] * 63], [None, *[1.0] * 63], [1e200] * 64, [1e-200] * 64, [1.0, 2.0], [2.0, 4.0]]
    return rows, spark.createDataFrame([(i, v, 1, True) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links int, kept boolean")


def plain_links(rows, at=0.9):
    out = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a and b and len(a) == len(b) and None not in a and None not in b and np.isfinite(a).all() and np.isfinite(b).all() and any(a) and any(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= at:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("tile", [512, 4])
def test_vectors_against_all_pairs(vectors, tile):
    rows, frame = vectors
    want = plain_links(rows)
    found = {r.vec_id: r for r in near_vectors(frame, tile=tile).collect()}
    assert len(found) == len(rows)
    degree = [sum(i in p for p in want) for i in range(len(rows))]
    assert all(found[i].n_links <= degree[i] for i in found)
    assert sum(r.n_links for r in found.values()) >= 0.95 * sum(degree)
    root = plain_components(len(rows), want)
    assert np.mean([found[i].component_id == root[i] for i in found]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_all_links_with_every_filter(vectors):
    rows, frame = vectors
    want = plain_links(rows)
    root = plain_components(len(rows), want)
    for tile in (512, 6):
        found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame, miss=0.0, codes=24, words=8, tile=tile).collect()}
        assert found == {i: (sum(i in p for p in want), root[i]) for i in range(len(rows))}


def pairs_at(cosines, dim, rng):
    x, y = rng.standard_normal((2, len(cosines), dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosines[:, None] * x + np.sqrt(1 - cosines[:, None] ** 2) * y


@pytest.mark.parametrize("dim", [3, 16, 64, 96, 128, 384, 768])
def test_pairs_share_a_filter_in_any_number_of_dimensions(dim):
    from millrace.llm.caps import MISS, Filters

    filters = Filters(dim)
    for cosine, missed in ((0.9001, 0.01), (0.92, 0.01), (0.95, 0.005), (0.99, 0.002)):
        x, y = pairs_at(np.full(2000, cosine), dim, np.random.default_rng(int(1000 * cosine) + dim))
        a, b = filters.of(x), filters.of(y)
        assert all(map(len, a)) and MISS < 0.01
        assert np.mean([np.intersect1d(p, q).size == 0 for p, q in zip(a, b, strict=True)]) <= missed


@pytest.mark.parametrize("kind", ["double", "float"])
def test_pairs_are_found_at_each_cosine(spark, kind):
    cosines = np.repeat([0.88, 0.899, 0.901, 0.92, 0.95, 0.98, 0.999], 300)
    x, y = pairs_at(cosines, 64, np.random.default_rng(11))
    rows = np.stack((x, y), 1).reshape(-1, 64).tolist()
    frame = spark.createDataFrame(list(enumerate(rows)), f"vec_id long, embedding array<{kind}>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame, tile=700).collect()}
    hit = np.array([found[2 * i] == (1, 2 * i) and found[2 * i + 1] == (1, 2 * i) for i in range(len(cosines))])
    assert not hit[cosines < 0.9].any() and hit[cosines > 0.9].mean() > 0.99


def test_vectors_without_a_filter_take_their_best():
    from millrace.llm.caps import Filters

    x = np.random.default_rng(2).standard_normal((50, 64))
    filters = Filters(64)
    filters.threshold = 0.9
    assert [len(f) for f in filters.of(x / np.linalg.norm(x, axis=1)[:, None])] == [1] * 50


def test_links_of_a_large_group_leave_no_pairs(spark):
    """300 vectors near one another: 44,850 links, yet no more rows than vectors and their filters."""
    from millrace.llm.caps import cap_links

    rng = np.random.default_rng(8)
    rows = (rng.standard_normal(64) + 0.05 * rng.standard_normal((300, 64))).tolist()
    frame = spark.createDataFrame([(i, 1, v) for i, v in enumerate(rows)], "key long, n long, v array<double>")
    found = cap_links(frame).collect()
    assert sum(r.linked for r in found) == 300 * 299 and len(found) < 300 * 40


def test_no_vectors(spark, vectors):
    assert near_vectors(vectors[1].limit(0)).count() == 0


def test_pipeline_stages(spark, corpus):
    docs, sf = corpus, "/root/testdata/sf0.01"
    for number, (name, work) in enumerate(corpus_pipeline.STAGES):
        after = work(spark, docs, sf)
        if number < 4:
            assert after.columns == corpus.columns
            rows = after.collect()
            assert 0 < len(rows) <= docs.count()
            docs = spark.createDataFrame(rows, corpus.schema)
    assert name == "packing" and after.count() > 0
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in after.collect()} == ids
    assert not docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count()


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    for empty in (False, True):
        rest = docs.limit(0) if empty else docs
        for _, work in corpus_pipeline.STAGES:
            work(spark, rest, "/root/testdata/sf0.01").collect()


def test_pipeline_leaves_columns_alone_whatever_their_names(spark, corpus):
    """Columns named like the stages' own results keep their values."""
    extra = ["score", "kept", "predicted", "offending", "anomaly", "base_failed", "n_words", "FP", "row", "body", "spans", "rules", "c0", "held", "__text", "__body"]
    docs = corpus.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for _, work in corpus_pipeline.STAGES[:4]:
        after = work(spark, docs, "/root/testdata/sf0.01")
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in extra)
        docs = spark.createDataFrame(rows, after.schema)


def test_pipeline_clears_what_its_stages_staged(spark, tmp_path):
    from millrace.llm import common

    other = common.stage(spark.range(3), "others")
    before = common.mark()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and other.count() == 3
    # the last stage's input and its own tables
    assert common.mark() - before <= 3
    common.clear(spark, before)
    assert common.mark() == before and other.count() == 3


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_staged_tables_can_be_cleared(spark):
    from millrace.llm import common

    common.stage(spark.range(3), "numbers")
    where = common._staged[-1].removeprefix("file:").replace("//", "/")
    from pathlib import Path

    assert Path(where).is_dir()
    common.clear(spark)
    assert not common._staged and not Path(where).exists()


def test_comparisons_grow_little_faster_than_vectors():
    """Five times the vectors: each meets less than twice as many others, and as few pairs at the limit are missed."""
    from millrace.llm.caps import Filters, words_for

    rng, met = np.random.default_rng(12), []
    for n in (20_000, 100_000):
        u = rng.standard_normal((n, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        filters = Filters(64, words=words_for(n))
        sizes = np.bincount(np.concatenate(filters.of(u)), minlength=filters.codes * filters.words**2).astype(float)
        met.append((sizes * (sizes - 1)).sum() / n)
        w = rng.standard_normal((2000, 64))
        w -= (w * u[:2000]).sum(1, keepdims=True) * u[:2000]
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        near = filters.of(0.9 * u[:2000] + np.sqrt(1 - 0.81) * w)
        assert np.mean([not np.intersect1d(x, y).size for x, y in zip(filters.of(u[:2000]), near)]) < 0.01
    assert words_for(100_000) > words_for(20_000) == 16 and met[1] < 2 * met[0]


def test_failing_stage_leaves_nothing_staged(spark, monkeypatch):
    from millrace.llm import common

    def broken(spark, docs, sf_dir):
        common.stage(docs.limit(1), "half")
        raise RuntimeError("lost")

    before = common.mark()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("same", lambda spark, docs, sf_dir: docs), ("broken", broken), ("never", broken)])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert common.mark() == before
