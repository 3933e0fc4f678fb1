"""The change envelope, source types and their names, and canonical column order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CREATE, UPDATE, DELETE, SNAPSHOT = "c", "u", "d", "r"
OPS = (CREATE, UPDATE, DELETE, SNAPSHOT)

_text_map = T.MapType(T.StringType(), T.StringType())

#: What a message's value holds.
ENVELOPE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("commit_ts", T.TimestampType()),
        T.StructField("pk", _text_map),
        T.StructField("after", _text_map),
        T.StructField("unchanged", T.ArrayType(T.StringType())),
        T.StructField("types", _text_map),
        # of a row that was moved from another key: that key
        T.StructField("prev_pk", _text_map),
        # the change's own place in the source's log, the same for both halves of a move
        T.StructField("seq", T.LongType()),
    ]
)
#: Fields that a change need not have.
LATER = ("prev_pk", "seq")
#: The envelope without these, and its place in the log.
CHANGE = T.StructType([*(f for f in ENVELOPE.fields if f.name not in LATER), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])

#: Type numbers of the source's catalog and their names.
TYPE_NAMES = {
    16: "boolean",
    20: "bigint",
    21: "smallint",
    23: "integer",
    25: "text",
    700: "real",
    701: "double precision",
    1042: "text",
    1043: "text",
    1082: "date",
    1114: "timestamp without time zone",
    1184: "timestamp with time zone",
    1700: "numeric",
    2950: "uuid",
    3802: "jsonb",
}
#: Types that a replica keeps; any other becomes text.
KEPT_TYPES = ("smallint", "integer", "bigint", "boolean", "numeric", "real", "double precision", "text", "date", "timestamp without time zone", "timestamp with time zone", "uuid", "jsonb")

#: Spark's type for each kept type.
SPARK_TYPES = {
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "numeric": T.DecimalType(38, 18),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "date": T.DateType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "timestamp with time zone": T.TimestampType(),
}


def type_name(oid: Column) -> Column:
    """A type number's name; ``text`` for unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, oid.cast("int")), F.lit("text"))


def replica_type(name: Column) -> Column:
    """The type a replica's column gets for a source type."""
    return F.when(name.isin(*KEPT_TYPES), name).otherwise(F.lit("text"))


def source_type(kind: T.DataType) -> str:
    """The source's name for a Spark type; ``text`` for those it has none for."""
    if isinstance(kind, T.DecimalType):
        return "numeric"
    return next((n for n, t in SPARK_TYPES.items() if t == kind), "text")


def spark_type(name: str) -> T.DataType:
    return SPARK_TYPES.get(name, T.StringType())


def decoded(text: Column, name: str) -> Column:
    """A source's text as the value of its type; malformed integers raise, booleans are ``t`` or not."""
    return text == "t" if name == "boolean" else text.cast(spark_type(name))


def ordered_columns(types: Iterable[str], keys: Iterable[str]) -> list[str]:
    """Keys by name, then the other columns by name."""
    keys = set(keys)
    return sorted(keys) + sorted(set(types) - keys)


def quoted(name: str) -> str:
    """A column name for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def quoted_table(name: str) -> str:
    """A table name with its schema; only the first dot parts the two."""
    return ".".join(map(quoted, name.split(".", 1)))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
