"""Tables, their keys and kinds; settings; Spark's catalog as the source's."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schema import ordered_columns


@dataclass(frozen=True)
class Table:
    """A published table: its key and column types, and whether it is a replica or derived."""

    name: str
    keys: dict[str, str]
    columns: dict[str, str]
    kind: str = "replica"

    def __post_init__(self):
        if not self.keys:
            raise ValueError(f"{self.name} has no key")

    @property
    def ordered(self) -> list[str]:
        return ordered_columns({**self.keys, **self.columns}, self.keys)

    def scan(self, spark: SparkSession, path: str) -> DataFrame:
        """The table's columns from Parquet, in canonical order."""
        return spark.read.parquet(path).select(*self.ordered)


@dataclass
class Registry:
    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, table: Table) -> None:
        self.tables[table.name] = table

    def published(self) -> list[str]:
        return sorted(self.tables)

    def replicas(self) -> list[str]:
        return sorted(n for n, t in self.tables.items() if t.kind == "replica")

    @staticmethod
    def described(df: DataFrame, name: str, keys: list[str]) -> Table:
        """A table from a frame's schema."""
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        return Table(name, {k: types[k] for k in keys}, {c: t for c, t in types.items() if c not in keys})


def catalog_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Names of a database's tables, in order."""
    return sorted(f"{database}.{t.name}" for t in spark.catalog.listTables(database) if not t.isTemporary)


def catalog_columns(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """(table, column, type, is_key, place) from a catalog's attributes and primary indexes.

    attributes(table, number, column, type, dropped); indexes(table, number, place) with the place of a column in the key. Dropped
    columns are left out; columns outside the key have no place. A table without a key has no key columns.
    """
    held = attributes.where(~F.col("dropped"))
    return held.join(indexes, ["table", "number"], "left").select("table", "column", "type", F.col("place").isNotNull().alias("is_key"), "place")


def tables_of(columns: DataFrame) -> dict[str, Table]:
    """Tables from ``catalog_columns``: keys in the index's order. Tables without a key can't be replicated and raise."""
    held: dict[str, list] = {}
    for r in columns.orderBy("table", F.asc_nulls_last("place"), "column").collect():
        held.setdefault(r["table"], []).append(r)
    return {t: Table(t, {r["column"]: r["type"] for r in rows if r["is_key"]}, {r["column"]: r["type"] for r in rows if not r["is_key"]}) for t, rows in held.items()}


_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds_of(text: str, default: float) -> float:
    """``1h30m``, ``2s``, ``10ms``; the default for anything else."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text or "")
    if not parts or "".join(a + b for a, b in parts) != text:
        return default
    return sum(float(n) * _UNITS[u] for n, u in parts)


def whole_number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"[0-9]+", text) else default


@dataclass(frozen=True)
class Settings:
    """What a deployment can set; read once from the environment, empty texts and malformed numbers counting as unset."""

    source: str = "wal"
    store: str = "store"
    checkpoints: str = "checkpoints"
    broker: str = "localhost:9092"
    topic: str = "cdc.events"
    slot: str = "millrace"
    publication: str = ""
    error_log: str = "errors.jsonl"
    hold: str = "hold"
    token: str = ""
    origins: str = "http://localhost:3000"
    rate_limit: int = 30
    flush_events: int = 500
    flush_seconds: float = 2.0
    vector_flush_events: int = 200
    vector_flush_seconds: float = 2.0
    embed_provider: str = "hash"
    embed_model: str = ""
    embed_url: str = ""
    embed_key: str = ""
    vector_dim: int = 1536
    embed_chunk: int = 64
    snapshot_seconds: float = 300.0
    partitions: int = 4

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "MILLRACE_") -> Settings:
        env = os.environ if env is None else env
        out = {}
        for name, of in cls.__dataclass_fields__.items():
            text = env.get(prefix + name.upper())
            if not text:
                continue
            out[name] = text if of.type == "str" else whole_number(text, of.default) if of.type == "int" else seconds_of(text, of.default)
        return cls(**out)

    def tables(self, registry: Registry) -> list[str]:
        """The tables that the publication names (separated by commas), or all."""
        wanted = {t.strip() for t in self.publication.split(",") if t.strip()}
        if missing := wanted - set(registry.published()):
            raise ValueError(f"not registered: {', '.join(sorted(missing))}")
        return [t for t in registry.published() if not wanted or t in wanted]

    def stream(self, spark: SparkSession):
        """The topic, in batches by number of events or age."""
        from millrace.sources.log import stream_topic

        return stream_topic(spark, self.broker, self.topic, self.flush_events, f"{self.flush_seconds:g}s")

    def wal(self, spark: SparkSession):
        """The rows of the recorded log's finished transactions, read in batches by number of changes or age of the first."""
        from millrace.sources.wal import stream_wal
        from millrace.streaming.transactions import committed

        return committed(stream_wal(spark, self.source, f"{self.store}/slots", self.slot, self.flush_events, self.flush_seconds))

    @property
    def every(self) -> str:
        return f"{self.flush_seconds:g} seconds"

    def embedder(self, transport=None):
        from millrace.functions.embed import make_embedder

        return make_embedder(self.embed_provider, self.vector_dim, self.embed_model, self.embed_url, self.embed_key, transport)
