"""``python -m millrace verify|latency``: check replicas and report their latency."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from millrace.operators import latency, verify
from millrace.streaming.store import Store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify")
    v.add_argument("--timeout", type=float, default=0.0)
    v.add_argument("--exact", action="store_true", help="one ordered digest a table, for tables of moderate size")
    v.add_argument("--source", action="append", required=True, help="table:key[,key]:parquet path")
    low = sub.add_parser("latency")
    low.add_argument("--table", required=True)
    low.add_argument("--csv")
    low.add_argument("--since")
    for s in (v, low):
        s.add_argument("--store", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "latency":
        replica = store.read(a.table)
        print(latency.report(replica, a.since))
        if a.csv:
            latency.write_csv(latency.by_minute(replica, a.since), a.csv)
        return 0
    sources = [x.split(":", 2) for x in a.source]

    def once() -> bool:
        tables, replicas = {}, {}
        for name, keys, path in sources:
            df = spark.read.parquet(path)
            tables[name] = (df, keys.split(","))
            replicas[name] = (store.read(name).select(*df.columns), keys.split(",")) if store.exists(name) else None
        rows = verify.compare(tables, replicas, a.exact).collect()
        for r in rows:
            print(r.table_name, "match" if r.matches else "MISMATCH", r.source_rows, r.replica_rows, verify.short(r.source_digest or ""), verify.short(r.replica_digest or ""))
        return all(r.matches for r in rows)

    return 0 if verify.converge(once, a.timeout) else 1


if __name__ == "__main__":
    sys.exit(main())
