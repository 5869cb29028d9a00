"""Dangling references against a plain statement of the rules."""

import datetime as dt
import itertools

import pytest

from orgweave.operators.references import dangling_references, domain_references


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_masks(spark, match):
    vals = [None, 1, 2]
    refs = [(i, a, b) for i, (a, b) in enumerate(itertools.product(vals, vals))] * 2  # repeated rows
    targets = [(1, 1), (1, 1), (2, None), (None, None)]
    r = spark.createDataFrame(refs, "_k0 int, a int, b int")  # an extra column with a clashing name
    t = spark.createDataFrame(targets, "a int, b int")
    got = [(x["_k0"], x["a"], x["b"]) for x in dangling_references(r, t, ["a", "b"], match).collect()]

    def dangling(a, b):
        if a is None and b is None:
            return False
        if a is None or b is None:
            if match != "partial":
                return match == "full"
        return not any((a is None or a == x) and (b is None or b == y) for x, y in targets)

    want = [(i, a, b) for i, a, b in refs if dangling(a, b)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty(spark):
    r = spark.createDataFrame([], "id int, a int")
    t = spark.createDataFrame([], "a int")
    assert dangling_references(r, t, ["a"]).count() == 0
    some = spark.createDataFrame([(1, 5), (2, None)], "id int, a int")
    assert [x.id for x in dangling_references(some, t, ["a"]).collect()] == [1]


def test_domains(spark):
    d = lambda m, day=1: dt.datetime(2025, m, day)
    clients = spark.createDataFrame(
        [(1, "x.test", "ag.test", d(1)), (2, "x.test", "gone.test", d(2)), (3, "-", None, d(3)), (4, "y.test", "AG.test", None)],
        "client_row bigint, client_domain string, agency_domain string, ingested_at timestamp",
    )
    agencies = spark.createDataFrame([("https://www.ag.test/", d(1, 31)), ("gone.test", d(1))], "agency_domain string, ingested_at timestamp")
    results = spark.createDataFrame([(9, "x.test", d(2, 28)), (8, "z.test", d(2))], "result_row bigint, domain string, ingested_at timestamp")
    removals = spark.createDataFrame([("agencies", "gone.test", d(2, 28))], "table_name string, domain string, removed_at timestamp")
    got = {(r.ref_field, r.period, r.row_id) for r in domain_references(clients, agencies, results, removals).collect()}
    assert got == {
        ("clients.client_domain", "2025-01", 1),  # scanned only in February
        ("clients.agency_domain", "2025-02", 2),  # removed before the month ended
        ("results.domain", "2025-02", 8),
    }


def test_hot_keys_are_spread(spark):
    from pyspark.sql import functions as F

    from orgweave.operators.skew import hot_keys, salted_join

    left = spark.range(6000).select((F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(7, "hot"), (1, "one"), (99999, "none")], "k bigint, t string")
    assert [r.k for r in hot_keys(left, ["k"]).collect()] == [7]
    for how in ("left", "inner"):
        got = sorted((r.k, r.v, r.t or "") for r in salted_join(left, right, ["k"], how).collect())
        assert got == sorted((r.k, r.v, r.t or "") for r in left.join(right, "k", how).collect())
    null_keys = left.withColumn("k", F.when(F.col("v") % 2 == 0, F.col("k")))
    assert salted_join(null_keys, right, ["k"]).count() == 6000
