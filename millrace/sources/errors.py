"""The error log: a line of JSON an error."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, service string, table string, message string, errorDetail string"
LIMIT = 100


def read_errors(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """The newest errors first; lines that don't parse are left out, a missing file has none."""
    try:
        rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.where("timestamp is not null").orderBy(F.desc("timestamp"), "service", "message").limit(limit)


def append_error(path: str, service: str, message: str, table: str | None = None, detail: str | None = None, at: datetime | None = None) -> None:
    """Add a line; never fails the caller."""
    entry = {"timestamp": (at or datetime.now(UTC)).isoformat(), "service": service, "table": table, "message": message, "errorDetail": detail}
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({k: v for k, v in entry.items() if v is not None}) + "\n")
    except OSError:
        pass
