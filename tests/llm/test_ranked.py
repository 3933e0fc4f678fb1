"""Exact top-k and hard negatives against all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import impact, queries, vptree
from millrace.llm.blocks import products
from tests.oracle import connect, differences

SCHEMA = "vec_id long, embedding array<double>, label int, RANK string, score double, number int"


def whole(v, factor):
    if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(factor * x) for x in v]


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1)


def plain_top_k(rows, k=20, factor=64, every=20):
    held = [(n, i, q) for n, (i, v, _) in enumerate(rows) if i is not None and (q := whole(v, factor))]
    out = []
    for n, i, q in held:
        if i % every == 0:
            others = sorted((-dot(q, p), j) for m, j, p in held if m != n and len(p) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(others[:k], 1)]
    return sorted(out)


def plain_negatives(rows, every=100, relabel=True):
    held = []
    for n, (i, v, label) in enumerate(rows):
        q = whole(v, 256)
        if i is not None and label is not None and q:
            held.append((n, i, q, (label + 1) % 10 if relabel and i % 7 == 0 else label))
    out = []
    for n, i, q, label in held:
        if i % every:
            continue
        met = [(-dot(q, p), j, c) for m, j, p, c in held if m != n and len(p) == len(q)]
        for s, j, _ in sorted(x for x in met if x[2] == label)[:5]:
            able = sorted((t, b) for t, b, c in met if c != label and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, j, rank, b, -s, -t) for rank, (t, b) in enumerate(able[:10], 1)]
    return sorted(out)


def made(seed, n=700, dim=12):
    """Clusters, copies (a third of all rows is one vector), repeated rows, sparse rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centre[i % 6] + 0.4 * rng.standard_normal(dim)
        if i % 3 == 0:
            v = centre[0]
        elif i % 5 == 0:
            v = np.where(rng.random(dim) < 0.7, 0.0, v)
        rows.append((i, v.tolist(), int(rng.integers(10))))
    rows += [rows[100], rows[40], rows[40], (None, rows[1][1], 1), (800, None, 2), (840, [], 2), (900, [math.nan] * dim, 3), (940, [1.0, None] * (dim // 2), 3)]
    rows += [(1000, [math.inf] * dim, 1), (1400, rows[2][1], None), (1100, [0.5, 0.25], 4), (1101, [0.5, -0.25], 4), (1102, [0.25, 0.2], 5), (1200, [0.0] * dim, 6), (1300, [-x for x in rows[0][1]], 6)]
    return rows


def frame_of(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 0.5, 7) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("size", [None, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed, size):
    rows = made(seed)
    found = impact.top_k(frame_of(spark, rows), rows=size)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_top_k(rows)


@pytest.mark.parametrize("size", [None, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, size):
    rows = made(seed)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = vptree.mine(frame_of(spark, rows), label=label, leaf=20, rows=size)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows)


def test_few_and_no_rows(spark):
    none = frame_of(spark, [])
    assert impact.top_k(none).collect() == [] and vptree.mine(none).collect() == []
    few = [(0, [1.0, 2.0], 1), (20, [0.5, 0.5], 1), (3, [0.5, 0.7], 2)]
    assert sorted(tuple(r) for r in impact.top_k(frame_of(spark, few)).collect()) == plain_top_k(few)
    assert sorted(tuple(r) for r in vptree.mine(frame_of(spark, few)).collect()) == plain_negatives(few, relabel=False)
    alone = [(0, [1.0, 2.0], 1), (None, None, None)]
    assert impact.top_k(frame_of(spark, alone)).collect() == [] and vptree.mine(frame_of(spark, alone)).collect() == []


def test_huge_components(spark):
    """Scores beyond exact doubles, and beyond a long."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * (1e8 if i < 40 else 1e15)).tolist(), i % 3) for i in range(60)]
    assert sorted(tuple(r) for r in impact.top_k(frame_of(spark, rows)).collect()) == plain_top_k(rows)
    assert sorted(tuple(r) for r in vptree.mine(frame_of(spark, rows), leaf=8).collect()) == plain_negatives(rows, relabel=False)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_exact_top_k"])
def test_same_rows_as_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert differences(queries.QUERIES[name](spark, folder), connect(folder), queries.oracles()[name]) == ""


def block_of(v, ids=None):
    members, edges, rests = impact.segments(v)
    n = np.arange(len(v))
    packed = {"ids": n if ids is None else ids, "rows": n, "vectors": v, "members": members, "edges": edges, "rests": rests}
    return impact.Block({"dim_": v.shape[1], "width": v.itemsize} | {c: x.tobytes() for c, x in packed.items()})


def test_stops_on_proof():
    """Where few components are large, the small ones are never added up; the result is exact all the same."""
    rng = np.random.default_rng(4)
    v = np.rint(np.where(rng.random((5000, 40)) < 0.06, 400, 2) * rng.standard_normal((5000, 40))).astype(np.int16)
    block = block_of(v)
    query, member, score, skipped = block.best(v[:50], list(range(50)), 20)
    assert skipped > 0.3 * 50 * len(block.members)
    all_scores = v[:50].astype(int) @ v.T.astype(int)
    np.fill_diagonal(all_scores, -(1 << 60))
    for q in range(50):
        want = np.lexsort((np.arange(len(v)), -all_scores[q]))[:20]
        assert member[query == q].tolist() == want.tolist() and score[query == q].tolist() == all_scores[q, want].tolist()


def test_segments_hold_every_component_once():
    v = np.random.default_rng(5).integers(-50, 50, (300, 9)).astype(np.int16)
    members, edges, rests = impact.segments(v)
    seen, level = defaultdict(list), []
    for s in range(len(edges) - 1):
        some = members[edges[s] : edges[s + 1]]
        for m in some:
            seen[int(m)].append(s % 9)
        if len(some):
            level.append((s // 9, np.abs(v[some, s % 9]).max()))
    assert all(sorted(seen[i]) == np.flatnonzero(v[i]).tolist() for i in range(300))
    assert all(a[1] >= b[1] or a[0] == b[0] for a, b in zip(level, level[1:]))
    assert (rests[-1] <= 1e-6).all()


def test_traversal_leaves_out_what_lies_outside():
    """Around an anchor in one of many clusters, the nearest rows and an annulus are answered from a part of the leaves."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((32, 16)) * 40
    v = np.rint(centre[np.arange(8192) % 32] + rng.standard_normal((8192, 16))).astype(np.int64)
    most = float((v * v).sum(1).max())
    order, spans, vantages, ranges = vptree.grown(vptree.augmented(v, most), 64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    packed = {"ids": order, "rows": order, "labels": order % 2, "vectors": v[order], "spans": spans, "vantages": np.where(vantages >= 0, place[vantages], -1), "ranges": ranges}
    tree = vptree.Tree({"dim_": 16, "width": 8, "most": most} | {c: x.tobytes() for c, x in packed.items()})
    leaves, first, second = len(v) // 64, [], []
    for a in range(0, 200, 7):
        scores = v @ v[a]
        member, score, read = tree.visit(v[a]).nearest(5, lambda i, j: tree.rows[i:j] != a)
        want = [x for x in np.lexsort((np.arange(len(v)), -scores)) if x != a][:5]
        assert tree.ids[member].tolist() == want and score.tolist() == scores[want].tolist()
        first.append(read)
        p = int(score[-1])
        member, score, read = tree.visit(v[a]).nearest(10, lambda i, j: tree.labels[i:j] != a % 2, -((-30 * p) // 100), 90 * p // 100)
        able = [x for x in np.lexsort((np.arange(len(v)), -scores)) if x % 2 != a % 2 and 30 * p <= 100 * scores[x] <= 90 * p][:10]
        assert tree.ids[member].tolist() == able
        second.append(read)
    assert np.mean(first) < 0.4 * leaves and np.mean(second) < 0.6 * leaves


def test_products():
    v = np.array([[1 << 62, 3], [5, -7]])
    assert products(v, v, np.array([0, 1, 1]), np.array([0, 0, 1]), 1e40).tolist() == [(1 << 63) - 1, (1 << 63) - 1, 74]
    assert products(v[1:], v[1:], np.array([0]), np.array([0]), 100.0).tolist() == [74]
