"""Stored indexes kept up by changes: vectors, keywords; against scans of everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import embed
from millrace.operators import retrieve
from millrace.operators.nearest import nearest
from millrace.streaming.store import Store
from millrace.streaming.vector_index import Reading, VectorIndex

VECTORS = "key string, embedding array<float>, updated_at timestamp"


def plain(df):
    return sorted((r.question_id, r.pos, r.key, round(r.score, 8)) for r in df.collect())


def made(spark, n, seed, first=0, dim=24):
    """Vectors around centres, some equal, and such as are near nothing."""
    rng = np.random.default_rng(seed)
    centre = np.random.default_rng(1).standard_normal((40, dim))
    rows = [(f"k{first + i}", (centre[rng.integers(40)] + 0.5 * rng.standard_normal(dim)).astype(np.float32).tolist(), None) for i in range(n)]
    rows += [(f"z{first}", [0.0] * dim, None), (f"y{first}", None, None), (f"x{first}", [float("nan")] * dim, None), (f"w{first}", [1.0, 2.0], None), (f"v{first}", rows[0][1], None)]
    return spark.createDataFrame(rows, VECTORS)


def brute(vectors, questions, k):
    out = []
    held = [(r.key, np.array(r.embedding, float), r.updated_at) for r in vectors.collect() if r.embedding]
    for q in questions.collect():
        u = np.array(q.embedding, float)
        scores = []
        for key, v, at in held:
            size = np.linalg.norm(u) * np.linalg.norm(v)
            if len(u) == len(v) and np.isfinite(size) and size > 0:
                scores.append((-round(float(u @ v / size), 9), -(at.timestamp() if at else -1e18), key))
        out += [(q.question_id, n, key, round(-s, 8)) for n, (s, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def questions_of(vectors, n=20):
    return vectors.where("embedding is not null").orderBy(F.xxhash64("key")).limit(n).select(F.col("key").alias("question_id"), "embedding")


def test_nearest_is_exact(spark, monkeypatch):
    import millrace.operators.nearest as N

    vectors = made(spark, 600, 3).withColumn("updated_at", F.when(F.col("key") == "v0", F.timestamp_micros(F.lit(5)))).repartition(3)
    asked = questions_of(vectors)
    want = brute(vectors, asked, 6)
    assert plain(nearest(vectors, asked, 6)) == want
    monkeypatch.setattr(N, "QUESTION_BYTES", 24 * 8 * 7)
    monkeypatch.setattr(N, "PRODUCTS", 500)
    assert plain(nearest(vectors, asked, 6)) == want
    assert nearest(vectors, asked.limit(0), 6).count() == 0 and nearest(vectors.limit(0), asked, 6).count() == 0
    assert all(r.key != r.question_id for r in nearest(vectors, asked, 6, own=True).collect())


def test_vector_index_follows_changes(spark, tmp_path):
    """After batches of new, moved and deleted vectors an exact search equals one over all vectors; a replayed batch changes nothing."""
    store = Store(spark, "file://" + str(tmp_path / "s"), 8)
    index = VectorIndex(store, "search.near")
    vectors = made(spark, 500, 4)
    index.build(vectors, 30)
    state = {r.key: r for r in vectors.collect()}
    asked = questions_of(vectors)
    assert plain(index.search(asked, 5)) == brute(vectors, asked, 5)
    rng = random.Random(5)
    for batch in range(2):
        keys = sorted(state)
        gone = spark.createDataFrame([(k,) for k in rng.sample(keys, 40)] + [("unknown",)], "key string")
        left = [k for k in keys if k not in {r.key for r in gone.collect()}]
        moved = made(spark, 60, 10 + batch).where("embedding is not null").limit(60).withColumn("key", F.element_at(F.array(*[F.lit(k) for k in rng.sample(left, 60)]), (F.row_number().over(__import__("pyspark").sql.Window.orderBy("key"))).cast("int")))
        new = moved.unionByName(made(spark, 50, 20 + batch, 1000 * (batch + 1))).persist()
        assert index.apply(new, gone, "q", batch) and not index.apply(new, gone, "q", batch)
        for r in gone.collect():
            state.pop(r.key, None)
        state |= {r.key: r for r in new.collect()}
        whole = spark.createDataFrame([tuple(r) for r in state.values()], VECTORS)
        reading = Reading()
        assert plain(index.search(asked, 5, reading=reading)) == brute(whole, asked, 5)
    assert reading.cells_a_question < 30


def test_vector_index_spares_the_driver(spark, tmp_path, monkeypatch):
    """Fitting and exact search hold nothing on the driver for vectors and cells, or questions and cells, together; vectors without structure make each question read most cells."""
    import tracemalloc

    import millrace.operators.nearest as N

    monkeypatch.setattr(N, "PRODUCTS", 1 << 16)
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(f"k{i}", rng.standard_normal(8).astype(np.float32).tolist(), None) for i in range(6000)], VECTORS).repartition(2).persist()
    asked = questions_of(vectors, 2000).persist()
    want = plain(nearest(vectors, asked, 3))
    index = VectorIndex(Store(spark, "file://" + str(tmp_path / "s"), 4), "many")
    reading = Reading()
    tracemalloc.start()
    try:
        index.build(vectors, 800)
        hits = index.search(asked, 3, reading=reading)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert plain(hits) == want and reading.cells_a_question > N.PRODUCTS / 2000
    # all pairs of questions and cells would take 12.8 MB, those of vectors and cells 38.4 MB
    assert peak < 8e6, peak


@pytest.mark.parametrize("n", [1000, 4000])
def test_recall_of_few_cells(spark, tmp_path, n):
    """Documents as hashed vectors: a part of the cells holds at least 0.95 of the five nearest."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 20").orderBy("doc_id").limit(n)
    vectors = docs.select(F.col("doc_id").cast("string").alias("key"), embed.hash_embed(F.col("text"), 64).alias("embedding")).persist()
    index = VectorIndex(Store(spark, "file://" + str(tmp_path / "s"), 16), "docs")
    index.build(vectors)
    asked = questions_of(vectors, 100)
    want = {(r.question_id, round(r.score, 6)) for r in nearest(vectors, asked, 5).collect()}
    reading = Reading()
    cells = index.centroids().shape[0]
    got = {(r.question_id, round(r.score, 6)) for r in index.search(asked, 5, probe=cells // 4, reading=reading).collect()}
    recall = len(got & want) / len(want)
    print(f"{n} vectors, {cells} cells, {reading.cells_a_question:.0f} read a question: recall {recall:.3f}")
    assert recall >= 0.95 and reading.cells_a_question <= cells / 4


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "key string, text string, updated_at timestamp")


def test_keyword_index_follows_changes(spark, tmp_path):
    """After random batches of new, changed and deleted documents the index answers like a scan of all texts, without reading one."""
    from datetime import datetime

    from millrace.streaming.keyword_index import KeywordIndex

    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]

    def text():
        # common words first, rare ones seldom
        return " ".join(rng.choice(words[: rng.choice((3, 10, 60))]) for _ in range(rng.choice((0, 3, 12, 30))))

    state = {f"d{i}": (text(), datetime(2024, 1, 1 + i % 20) if i % 4 else None) for i in range(150)}
    state["d3"] = (None, None)
    store = Store(spark, "file://" + str(tmp_path / "s"), 8)
    index = KeywordIndex(store, "words")
    index.build(texts_of(spark, [(k, *v) for k, v in state.items()]))
    asked = spark.createDataFrame([(i, text()) for i in range(25)] + [(90, "nothing known"), (91, None), (92, "w0 w1 w2"), (93, "w0")], "question_id long, text string")

    def check():
        docs = texts_of(spark, [(k, *v) for k, v in state.items()])
        want = retrieve.top(retrieve.keyword_scores(docs, retrieve.question_terms(asked)), docs)
        assert plain(index.search(asked)) == plain(want)
        assert plain(index.search(asked, first=1)) == plain(want)
        assert index.count() == len(state)

    check()
    for batch in range(3):
        gone = rng.sample(sorted(state), 15) + ["unknown"]
        new = [(k, text(), datetime(2024, 2, 1 + batch)) for k in rng.sample(sorted(state), 30)] + [(f"n{batch}-{i}", text(), None) for i in range(20)]
        deletes = spark.createDataFrame([(k,) for k in gone], "key string")
        assert index.apply(texts_of(spark, new), deletes, "q", batch) and not index.apply(texts_of(spark, new), deletes, "q", batch)
        state |= {k: v for k, *v in new}
        for k in gone:
            state.pop(k, None)
    check()
    read = [str(f) for f in index.search(asked).inputFiles()]
    assert not any(index.documents in f for f in read)


def test_keyword_index_adds_parts(spark, tmp_path, monkeypatch):
    """A batch adds its own rows and rewrites no bucket; deleted keys that come back count once; after some parts the tables are written anew. Answers stay those of a scan."""
    import millrace.streaming.keyword_index as K

    monkeypatch.setattr(K, "POSTINGS", 50)
    monkeypatch.setattr(K, "BLOCK", 3)
    store = Store(spark, "file://" + str(tmp_path / "s"), 2)
    index = K.KeywordIndex(store, "words")
    state = {i: f"all w{i % 7} w{i % 5} alone{i}" if i % 9 else None for i in range(60)}
    made = lambda rows: spark.createDataFrame(rows, "key long, text string")
    asked = spark.createDataFrame([(1, "all w3"), (2, "w1 w2 new"), (3, "alone4 alone5"), (4, "all"), (5, "")], "question_id long, text string")

    def check():
        docs = made(list(state.items())).withColumn("updated_at", F.lit(None).cast("timestamp"))
        want = retrieve.top(retrieve.keyword_scores(docs, retrieve.question_terms(asked)), docs)
        assert plain(index.search(asked)) == plain(want) and index.count() == len(state)

    def apply(new, gone):
        index.apply(made(new), made([(k, None) for k in gone]))
        state.update(new)
        for k in gone:
            state.pop(k, None)

    files = lambda: {p for t in (index.postings, index.documents) for p in store.read(t).inputFiles()}
    index.build(made(list(state.items())))
    first, rows = files(), store.read(index.postings).count()
    apply([(5, "all new"), (100, "w1 new")], [4, 6, 999])
    assert first < files() and store.read(index.postings).count() <= rows + 4
    check()
    apply([(4, "back alone4"), (5, "w2 w3")], [100])
    check()
    apply([], [])
    apply([], [7])
    check()
    monkeypatch.setattr(K, "PARTS", 4)
    apply([(8, "all new")], [9])
    assert not first & files() and store.read(index.gone).count() == 0 and store.read(index.documents).count() == len(state)
    check()
    apply([(9, "w9 new")], [8])
    check()


def test_documents_keep_their_indexes(spark, tmp_path):
    """The document writer's batches reach both indexes in the same commit; live answers are those of a scan."""
    from millrace import control
    from millrace.functions.text import english
    from millrace.plans import workload as w
    from millrace.sources import log, registry
    from millrace.streaming.keyword_index import KeywordIndex
    from millrace.streaming.replicate import DocumentWriter
    from tests.conftest import SF

    tables = registry.Registry()
    tables.add(registry.Table(w.USER_STATE, w.USER_KEYS, w.USER_COLUMNS))
    store = Store(spark, "file://" + str(tmp_path / "docs"), 4)
    hashed = embed.HashEmbedder(32)
    words, vectors = KeywordIndex(store, "search.words", english), VectorIndex(store, "search.near")
    writer = DocumentWriter(store, tables, "docs", {w.USER_STATE: ["event_type"]}, lambda f: f.withColumn("text", F.concat(F.lit("user "), F.try_element_at("pk", F.lit("user_id")), F.lit(" did "), F.col("event_type"))), lambda t: embed.hash_embed(t, 32), words=words, vectors=vectors)
    events = w.event_log(spark, SF)
    for n, (lo, hi) in enumerate(((0, 500), (500, 2000))):
        path = str(tmp_path / f"log{n}")
        log.publish(events.where((F.col("offset") >= lo) & (F.col("offset") < hi)), path, 2)
        writer.batch(log.read_log(spark, path), n)
        if not n:
            writer.index(6)
    docs = store.read(writer.VECTORS)
    assert words.count() == docs.count() == store.read(vectors.places).count() == store.read(vectors.rows).count()
    service = control.Service(store, tables, str(tmp_path / "errors"))
    for question in ("which click", "user 7 did what", "zebra"):
        scan = service.ask(question, "live", writer.VECTORS, hashed)
        assert service.ask(question, "live", writer.VECTORS, hashed, words=words, vectors=vectors) == scan


def test_keyword_top_keeps_few_rows(spark, monkeypatch):
    """Common terms and ties: the same hits as by all scores, while no exchange gets a row a document."""
    rng = random.Random(4)
    docs = texts_of(spark, [(f"d{i}", rng.choice(("red", "red blue", "blue green", "", None)), None) for i in range(3000)]).withColumn("updated_at", F.when(F.col("key") == "d9", F.timestamp_micros(F.lit(5)))).repartition(3)
    asked = retrieve.question_terms(spark.createDataFrame([(1, "red"), (2, "blue red"), (3, "none"), (4, None), (5, "green blue")], "question_id long, text string"))
    want = plain(retrieve.top(retrieve.keyword_scores(docs, asked), docs))
    assert want and plain(retrieve.keyword_top(docs, asked)) == want
    monkeypatch.setattr(retrieve, "ASKED", 1)
    monkeypatch.setattr(retrieve, "SLICE", 7)
    found = retrieve.keyword_top(docs, asked)
    assert plain(found) == want
    taken = []
    whole = retrieve.merged
    monkeypatch.setattr(retrieve, "merged", lambda hits, k: taken.append(hits.count()) or whole(hits, k))
    retrieve.keyword_top(docs, asked)
    assert 0 < taken[0] <= 3 * 3 * retrieve.TOP
    assert retrieve.keyword_top(docs.limit(0), asked).count() == 0


def test_best_holds_k_a_question():
    """Many questions that take up all first vectors hold k hits each, as sorting everything gives them."""
    from millrace.operators.nearest import Best

    rng = np.random.default_rng(3)
    score, times, keys = np.round(rng.random((300, 900)), 2), rng.integers(0, 3, 900), np.arange(900).astype(object)
    best = Best(list(range(300)), 4, own=True)
    for start in range(0, 900, 90):
        best.take(np.arange(300), score[:, start : start + 90], keys[start : start + 90], times[start : start + 90])
        assert best.key.shape == (300, 4) and best.held.max() <= 4
    got = {(q, k) for columns in best.rows() for q, k in zip(*columns[:2])}
    assert got == {(q, k) for q in range(300) for k in sorted((k for k in range(900) if k != q), key=lambda k: (-score[q, k], -times[k], k))[:4]}


def small_tables(path, **rows):
    """Tables of a few rows (id, text) as parquet files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, (key, held) in rows.items():
        pq.write_table(pa.table({key: pa.array([r[0] for r in held], pa.int64()), "text": pa.array([r[1] for r in held], pa.string())}), f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["hybrid_search", "keyword_topk"])
def test_all_words_of_a_question_count(spark, tmp_path, name):
    """A question's last words in order of their bytes bring up the document that alone holds them, as its SQL says."""
    from millrace.plans import catalog
    from tests.oracle import connect, differences

    common = "ant bee cat dog eel fox gnu hen"
    docs = [(i, f"{common} number{i} " + "filler " * i) for i in range(20)] + [(90, "yak zebra " + "other " * 300), (91, None), (92, "")]
    sf = small_tables(tmp_path, documents=("doc_id", docs), benchmark=("item_id", [(1, f"{common} yak zebra"), (2, "zebra"), (3, None), (4, common + " " + common)]))
    found = catalog.QUERIES[name](spark, sf)
    assert differences(found, connect(sf), catalog.SQL[name]) == ""
    assert 90 in {r.doc_id for r in found.where("question_id = 1").collect()}
