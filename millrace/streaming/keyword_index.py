"""A stored keyword index, kept up by the change stream: postings, document frequencies and the number of documents.

Five things in the store, changed in one commit: ``postings`` (blocks of the keys that hold a term, dealt to shares, so that a common term is spread
over buckets), ``documents`` (each key's words, which tell what to take back when its text changes or goes), ``gone`` (keys whose earlier rows
don't count any more), ``terms`` (what gone texts take from the terms' frequencies), and the number of documents as a note on them. A question never reads a text.

A batch of changes is a part of its own: it adds rows to the tables and rewrites none. A key's row counts unless a later part has noted the key as gone. When there
are ``PARTS`` parts, or as many documents were added as there are, the next batch writes the tables anew from the words that count.

A document's score is the sum of the weights of the question's terms that it holds, so the best documents are found rarest terms first: those of the
first terms give a lower bound for the k-th score. A term that is essential, as it and all commoner ones together can reach that
bound, gives candidates; the others' postings only count for these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.text import tokens
from millrace.operators.retrieve import TOP, question_terms
from millrace.streaming.store import ADDED, Store

#: Shares that a term's postings are dealt to, and terms that a lower bound is taken from.
SHARES, FIRST = 16, 2
#: Postings that a task puts in blocks at a time, keys of a block, and blocks that it sends at a time.
POSTINGS, BLOCK, SENT = 2_000_000, 4096, 10_000
#: Batches of changes after which the tables are written anew.
PARTS = 32
#: What stands between stored words.
BETWEEN = "\n"


class KeywordIndex:
    """An index named ``name`` in a store. ``split`` makes words of a text, for documents and questions alike; a word holds no line break."""

    def __init__(self, store: Store, name: str, split: Callable = tokens):
        self.store, self.split = store, split
        self.postings, self.terms, self.documents, self.gone = (f"{name}.{x}" for x in ("postings", "terms", "documents", "gone"))

    def exists(self, state: dict | None = None) -> bool:
        return self.store.exists(self.documents, state)

    def _words(self, docs: DataFrame) -> DataFrame:
        updated = F.col("updated_at") if "updated_at" in docs.columns else F.lit(None).cast("timestamp")
        words = F.coalesce(F.array_distinct(self.split(F.col("text"))), F.array().cast("array<string>"))
        return docs.select("key", F.array_join(words, BETWEEN).alias("words"), updated.alias("updated_at"))

    def _posted(self, words: DataFrame, part: int) -> DataFrame:
        """Blocks (term, share, part, n, keys, updated) of documents' words. A task puts its documents together, so a posting leaves it as little more than its key."""
        share = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(SHARES)).cast("int").alias("share")
        each = words.select("key", _apart(F.col("words")).alias("words"), share, F.unix_micros("updated_at").alias("at"))
        schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("share", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(words.schema["key"].dataType)), T.StructField("updated", T.ArrayType(T.LongType()))])
        types = [to_arrow_type(f.dataType) for f in schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch.column(1).flatten())
                if n >= POSTINGS:
                    yield from _blocks(held, part, schema.names, types)
                    held, n = [], 0
            if n:
                yield from _blocks(held, part, schema.names, types)

        return each.mapInArrow(run, schema)

    def _whole(self, words: DataFrame, n: int) -> tuple[dict, dict]:
        """All tables of these words, as their first part."""
        spark, key = self.store.spark, words.schema["key"]
        none = lambda *more: spark.createDataFrame([], T.StructType(list(more)))
        tables = {
            self.postings: (self._posted(words, 0), ["term", "share"], None),
            self.terms: (none(T.StructField("term", T.StringType()), T.StructField("share", T.IntegerType()), T.StructField("df", T.LongType())), ["term", "share"], None),
            self.documents: (words.withColumn("part", F.lit(0)), ["key"], None),
            self.gone: (none(T.StructField("key", key.dataType), T.StructField("part", T.IntegerType())), ["key"], None),
        }
        return tables, {self.documents: {"documents": n, "part": 0, "added": 0}}

    def build(self, docs: DataFrame, query: str | None = None, batch: int | None = None) -> bool:
        """Index documents (key, text, updated_at); keys are unique."""
        base = self.store.manifest()
        tables, notes = self._whole(self._words(docs), docs.count())
        return self.store.commit(tables, query, batch, base=base, meta=notes)

    def _counting(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (key, part) that no later part has noted as gone."""
        gone = self.store.read(self.gone, None, state).groupBy("key").agg(F.max("part").alias("gone"))
        return rows.join(gone, (rows["key"] == gone["key"]) & (F.col("part") < F.col("gone")), "left_anti")

    def changes(self, docs: DataFrame, deletes: DataFrame, base: dict) -> tuple[dict, dict]:
        """The tables to commit, and notes on them, for documents that are new or changed and keys that are gone."""
        s, note = self.store, self.store.meta(self.documents, base)
        # counted first, so that their sizes are known where they are joined
        keys = docs.select("key").unionByName(deletes.select("key")).distinct().persist()
        keys.count()
        new = self._words(docs).join(deletes.select("key"), "key", "left_anti").persist()
        added = new.count()
        held = s.read(self.documents, s.touched(keys, ["key"], self.documents, base), base)
        old = self._counting(held.join(keys, "key"), base).persist()
        n, part = note["documents"] + added - old.count(), note["part"] + 1
        if part > PARTS or note["added"] + added > max(n, 1):
            rest = self._counting(s.read(self.documents, None, base), base).join(keys, "key", "left_anti")
            return self._whole(rest.select(*new.columns).unionByName(new), n)
        taken = old.select(F.explode(_apart(F.col("words"))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        tables = {
            self.postings: (self._posted(new, part), ["term", "share"], ADDED),
            self.terms: (taken.select("term", F.lit(0).alias("share"), "df"), ["term", "share"], ADDED),
            self.documents: (new.withColumn("part", F.lit(part)), ["key"], ADDED),
            self.gone: (old.select("key", F.lit(part).alias("part")), ["key"], ADDED),
        }
        return tables, {self.documents: {"documents": n, "part": part, "added": note["added"] + added}}

    def apply(self, docs: DataFrame, deletes: DataFrame, query: str | None = None, batch: int | None = None) -> bool:
        """Take up a batch of changes; False if the query has committed it before. A key that is both changed and deleted goes."""
        base = self.store.manifest()
        if query is not None and batch is not None and self.store.committed(query, base) >= batch:
            return False
        tables, notes = self.changes(docs, deletes, base)
        return self.store.commit(tables, query, batch, base=base, meta=notes)

    def count(self, state: dict | None = None) -> int:
        """How many documents there are."""
        return self.store.meta(self.documents, state)["documents"]

    def _read(self, table: str, terms: DataFrame, state: dict) -> DataFrame:
        """What a table holds of the terms, from their buckets only."""
        places = terms.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        n = state["tables"][table]["buckets"]
        buckets = sorted(r[0] for r in places.select(self.store.bucket(["term", "share"], n)).distinct().collect())
        return self.store.read(table, buckets, state).join(terms, "term", "left_semi")

    def search(self, questions: DataFrame, k: int = TOP, terms: int | None = None, first: int = FIRST) -> DataFrame:
        """(question_id, key, score, updated_at, pos): each question's best ``k``, by score, then newest, then key; by all its words, or the first ``terms`` in order of their bytes."""
        state = self.store.manifest()
        asked = question_terms(questions, terms, split=self.split).persist()
        # what is asked is counted first, so that its size is known where it is joined: where it is small, postings stay where they are read
        words = asked.select("term").distinct().persist()
        words.count()
        blocks = self._read(self.postings, words, state)
        df = blocks.select("term", "n").unionByName(self._read(self.terms, words, state).select("term", F.col("df").alias("n"))).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        w = Window.partitionBy("question_id").orderBy("df", "term")
        weight = asked.join(df, "term").withColumn("w", F.log(1 + F.lit(float(self.count(state))) / F.col("df")))
        # a term's place from the rarest on, and what it and all after it can add
        weight = weight.withColumns({"place": F.row_number().over(w), "rest": F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing))}).persist()
        weight.count()

        def met(rows: DataFrame) -> DataFrame:
            found = blocks.join(rows.select("term").distinct(), "term", "left_semi").select("term", "part", "updated", F.posexplode("keys").alias("i", "key"))
            return self._counting(found, state).select("term", "key", F.timestamp_micros(F.get("updated", F.col("i"))).alias("updated_at")).join(rows, "term")

        early = met(weight.where(F.col("place") <= first)).groupBy("question_id", "key").agg(F.sum("w").alias("s"))
        by_score = Window.partitionBy("question_id").orderBy(F.desc("s"))
        bound = early.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("question_id", F.col("s").alias("least"))
        judged = weight.join(bound, "question_id", "left").withColumn("essential", F.col("least").isNull() | (F.col("rest") >= F.col("least") - 1e-9)).persist()
        judged.count()
        hits = met(judged.where("essential")).select("question_id", "key", "updated_at", "w")
        able = hits.select("question_id", "key").distinct()
        more = met(judged.where("not essential")).join(able, ["question_id", "key"]).select("question_id", "key", "updated_at", "w")
        scores = hits.unionByName(more).groupBy("question_id", "key").agg(F.sum("w").alias("score"), F.max("updated_at").alias("updated_at"))
        w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), F.desc_nulls_last("updated_at"), "key")
        return scores.where("score > 0").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("question_id", "key", "score", "updated_at", "pos")


def _apart(words):
    """Stored words as a list."""
    return F.filter(F.split(words, BETWEEN, -1), lambda x: x != "")


def _blocks(batches: list[pa.RecordBatch], part: int, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Documents (key, words, share, at) as blocks: a term's keys in the documents' order, at most ``BLOCK`` in one, in its first document's share."""
    key, words, share, at = (pa.chunked_array([b.column(i) for b in batches]).combine_chunks() for i in range(4))
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    doc = np.repeat(np.arange(len(words)), np.array(words.value_lengths().fill_null(0)))[order]
    code = code[order]
    begun = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    place = np.arange(len(code)) - np.repeat(begun, np.diff(np.r_[begun, len(code)]))
    first = np.flatnonzero(place % BLOCK == 0)
    ends = np.r_[first, len(code)]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(doc)))
    n = len(first)
    columns = [
        coded.dictionary.take(pa.array(code[first])), share.take(pa.array(doc[first])), pa.array(np.full(n, part, np.int32)), pa.array(np.diff(ends)),
        lists(key), pa.nulls(n, pa.list_(pa.int64())) if at.null_count == len(at) else lists(at),
    ]
    out = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)
    for start in range(0, n, SENT):
        yield out.slice(start, SENT)
