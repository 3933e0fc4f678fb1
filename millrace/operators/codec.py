"""Messages to change rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import CHANGE, ENVELOPE, LATER, OPS


#: Times keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def canonical(pk: Column) -> Column:
    """JSON of a key with its columns in order of their names."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pk))))


def message_key(table: Column, pk: Column) -> Column:
    """The log's partitioning key: rows with one key keep their order."""
    return F.concat(table, F.lit(":"), canonical(pk))


def encoded(changes: DataFrame) -> DataFrame:
    """Change rows as ``key`` and ``value`` of messages; null fields stay in the JSON.

    Without ``prev_pk`` no row was moved; without ``seq`` a change's ``offset`` is its place in the source's log.
    """
    seq = F.col("seq") if "seq" in changes.columns else F.col("offset") if "offset" in changes.columns else F.lit(None)
    prev = F.col("prev_pk") if "prev_pk" in changes.columns else F.lit(None)
    fields = [*(F.col(n) for n in ENVELOPE.names if n not in LATER), prev.cast("map<string,string>").alias("prev_pk"), seq.cast("long").alias("seq")]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", **TIMES})
    rest = [c for c in ("partition", "offset") if c in changes.columns]
    return changes.select(message_key(F.col("table"), F.col("pk")).alias("key"), value.alias("value"), *rest)


def _change() -> Column:
    schema = T.StructType([*ENVELOPE.fields, T.StructField("_corrupt", T.StringType())])
    return F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **TIMES})


def _fault(c: Column) -> Column:
    """What is wrong with a parsed message, or null."""
    return (
        F.when(F.col("value").isNull() | c.isNull() | c["_corrupt"].isNotNull(), "not an event")
        .when(F.coalesce(c["op"], F.lit("")) == "", "no op")
        .when(F.coalesce(c["table"], F.lit("")) == "", "no table")
        .when(~c["op"].isin(*OPS), "unknown op")
    )


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with ``change`` and ``error``; a message without op or table, or that isn't JSON, has an error."""
    return messages.withColumn("change", _change()).withColumn("error", _fault(F.col("change")))


def decoded(messages: DataFrame) -> DataFrame:
    """The change rows of well-formed messages."""
    place = [F.col(c).cast(CHANGE[c].dataType).alias(c) for c in ("partition", "offset") if c in messages.columns]
    # judged as a list of one, so that a message is parsed once; a filter would parse it anew for each of its conditions
    fine = F.filter(F.array(_change()), lambda c: _fault(c).isNull())
    return messages.select(*place, F.inline(fine)).select(*ENVELOPE.names, *[c for c in ("partition", "offset") if c in messages.columns])


def rejected(messages: DataFrame) -> DataFrame:
    """The messages that are no change, with ``error``, for a quarantine."""
    return parsed(messages).where("error is not null").drop("change")
