"""Trees of digests against row-by-row comparison."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import digests
from millrace.plans import workload as w
from tests.conftest import SF_MORE


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_keys_of_what_differs(spark):
    orders = w.table(spark, SF_MORE, "orders")
    some = [r[0] for r in orders.select("o_orderkey").orderBy(F.xxhash64("o_orderkey")).limit(3).collect()]
    copy = orders.where(F.col("o_orderkey") != some[0]).withColumn("o_orderstatus", F.when(F.col("o_orderkey") == some[1], F.lit(None)).otherwise(F.col("o_orderstatus")))
    copy = copy.unionByName(orders.where(F.col("o_orderkey") == some[2]).withColumn("o_orderkey", F.lit(-5).cast("long")))
    assert plain(digests.differences(orders, copy.repartition(3), ["o_orderkey"])) == sorted([(some[0], "missing"), (some[1], "changed"), (-5, "extra")], key=repr)
    assert plain(digests.differences(orders, orders.repartition(7, "o_custkey"), ["o_orderkey"])) == []
    assert digests.differences(orders.limit(0), orders.limit(0), ["o_orderkey"]).count() == 0
    assert {r.difference for r in digests.differences(orders.limit(0), orders, ["o_orderkey"]).collect()} == {"extra"}


def test_only_paths_that_differ_are_followed(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7).alias("v"))
    copy = rows.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v")))
    a, b = digests.tree(rows, ["id"], 3), digests.tree(copy, ["id"], 3)
    assert len(a) == 4 and a[0].first().n == 5000 and a[0].first().hash_sum != b[0].first().hash_sum
    (node,) = digests.differing(a, b)
    assert node == rows.where("id = 77").select(digests.leaf(rows, ["id"], 3)).first()[0]
    assert digests.differing(a, a) == []


def test_ties_nulls_and_repeated_rows(spark):
    schema = "a string, b int, v double"
    left = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 1.0), (None, 2, 2.0), ("y", None, None), ("z", 3, 3.0)], schema)
    right = spark.createDataFrame([("x", 1, 1.0), (None, 2, 2.5), ("y", None, None), ("z", 3, 3.0)], schema)
    assert plain(digests.differences(left, right.select("v", "b", "a"), ["a", "b"])) == sorted([("x", 1, "changed"), (None, 2, "changed")], key=repr)
    with pytest.raises(ValueError):
        digests.leaves(left, [])


def test_ordered_digest_over_many_ranges(spark):
    """Blocks of several ranges and repeated keys come in order; the last task reads 16 bytes a row, in blocks."""
    import hashlib

    from pyspark.sql import functions as F

    from millrace.operators import verify

    rows = spark.range(5000).select((F.col("id") % 4000).alias("k"), F.lit("x").alias("v")).repartition(5)
    want = hashlib.md5("".join(hashlib.md5(f"{k}|x".encode()).hexdigest() for k in sorted((str(i % 4000) for i in range(5000)))).encode()).hexdigest()
    found = verify.checksum(rows, ["k"])
    assert tuple(found.first()) == (5000, want)
    assert "listagg" not in found._jdf.queryExecution().toString()
    assert tuple(verify.checksum(rows.limit(0), ["k"]).first()) == (0, "")
