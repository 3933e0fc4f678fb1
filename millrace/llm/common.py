"""Shared plumbing: shared-folder tables, Arrow maps over documents, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows turned into Python objects at a time; bounds a worker's memory.
SLICE = 256
TEXT = "__text"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets
    a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return made


_staged: list[str] = []


def mark() -> int:
    """A point in this process's staging, for ``clear``."""
    return len(_staged)


def clear(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete what this process has staged since a ``mark``, but for the last table where that is asked for.

    Call it when the results that read the tables are written.
    """
    jvm = spark.sparkContext._jvm
    gone = _staged[since : len(_staged) - but_last]
    _staged[since:] = _staged[len(_staged) - but_last :] if len(_staged) > since else []
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    This cuts the lineage: after the loss of an executor only reads are repeated. A retried
    task overwrites its own attempt, so the table holds each row once.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    _staged.append(folder)
    path = f"{folder}/{name}"
    out = df.write.option("compression", "zstd")
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` whose names, whatever their case, are not among ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def with_text(df: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the text as ``__text``, null texts as empty ones."""
    return df.select(*[F.col(quoted(c)) for c in keep], F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias(TEXT))


def per_document(df: DataFrame, keep: Sequence[str], fields: str, make: Callable[[], Callable], text_col: str = "text") -> DataFrame:
    """Add ``fields`` (a DDL string) to the columns ``keep``, computed from each row's text.

    ``make`` runs once a task and returns a function from a list of texts to one list a
    field. Null texts count as empty; a kept column named like a field gives way to it.
    """
    new = T._parse_datatype_string(fields)
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in new}]
    # a kept text is sent once
    own = next((i for i, c in enumerate(keep) if c.lower() == text_col.lower() and isinstance(df.schema[c].dataType, T.StringType)), None)
    source = with_text(df, keep, text_col) if own is None else df.select(*[F.col(quoted(c)) for c in keep])
    kept = len(keep)
    schema = T.StructType([*source.schema.fields[:kept], *new.fields])
    types = [to_arrow_type(f.dataType) for f in new]
    names = schema.names

    def run(batches):
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                done = work([t or "" for t in batch.column(kept if own is None else own).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(x, t) for x, t in zip(done, types, strict=True))], names)

    return source.mapInArrow(run, schema)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns, named ``c0``, ``c1``, ...: names that clash with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def number_of(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives a column."""
    return f"c{[c.lower() for c in df.columns].index(name.lower())}"


def fold_of(id_col: str, m: int):
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % m


#: Most partitions that ``spread`` asks for; beyond it a partition holds several groups.
PARTITIONS = 100_000


def spread(df: DataFrame, groups: int, key: str) -> DataFrame:
    """Shuffled by ``key`` into a partition a group where there are more groups than the session has partitions.

    So what a task reads stays as large as a few groups however many there are; grouping by ``key`` needs no other shuffle.
    """
    return df.repartition(min(groups, PARTITIONS), key) if groups > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: columns ``node``, ``component``.

    ``component`` is the smallest node reachable. Nodes without an edge to another node
    have no row. Large-star and small-star steps alternate, each round a written table, until
    a round changes nothing; hubs are met by partial minima and joins, never gathered.
    """
    x, y = F.col(quoted(a)), F.col(quoted(b))
    graph = stage(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = graph.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return graph.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(graph.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join on a hub can be split
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        graph = stage(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
