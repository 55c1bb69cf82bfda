"""What the search queries hold in memory: rows on their way, and batches in Python."""

import re

import pytest

import __spark_entry__ as e
from lodestone.operators import retrieval as rt
from lodestone.plans import search as se
from lodestone.sources.tables import arrow_rows

TINY = "/root/testdata/sf0.001"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_moved_before_they_are_sorted(spark):
    """Below the exchange nothing is sorted: a task that reads a large row group does not hold its bodies twice."""
    plan = physical(se.Corpus(spark, TINY).evidence.select("id", "body"))
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange") :]


def test_one_each_keeps_one_row_of_each_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)], "id string, n int")
    assert sorted(map(tuple, rt.one_each(df).collect()), key=str) == sorted([("a", 1), ("b", 2), (None, 3)], key=str)


def test_bodies_of_contexts_are_not_shuffled(spark):
    """search_results returns digests, and only these are moved."""
    plan = physical(e.queries()["search_results"](spark, TINY))
    scans = [set(re.findall(r"(\w+)#", line[line.index("[") : line.index("]")])) for line in plan.splitlines() if "FileScan" in line]
    assert any("body" in s for s in scans)
    assert not re.search(r"Exchange hash\w*\(.*body#|first\(body#", plan) and "md5" in plan[plan.rindex("Exchange", 0, plan.index("md5(")) :]


def test_vectors_of_queries_are_moved_once(spark):
    """The contexts are asked by ids alone: between the join with them and the distinct vectors nothing is moved."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        plan = physical(se.known_item_queries(se.Corpus(spark, TINY)))
    finally:
        spark.conf.set(name, old)
    above = plan[: plan.index(" first(embedding#")]
    assert "Exchange" not in above[above.rindex("SortMergeJoin") :]


@pytest.mark.parametrize(("before", "most", "within"), [("10000", 2000, "2000"), ("500", 2000, "500"), ("0", 2000, "2000"), ("-1", 7, "7")])
def test_arrow_rows(spark, before, most, within):
    old = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, before)
        with pytest.raises(ValueError), arrow_rows(spark, most):
            assert spark.conf.get(ROWS) == within
            raise ValueError
        assert spark.conf.get(ROWS) == before
    finally:
        spark.conf.set(ROWS, old)


def test_routes_send_small_batches(spark, monkeypatch):
    """Both routes, and the rows are those of large batches."""
    seen = []
    write = se.materialize
    monkeypatch.setattr(se, "materialize", lambda df, label="t": (seen.append((label, spark.conf.get(ROWS))), write(df, label))[1])
    rows = lambda config: {n: sorted(map(tuple, df.collect())) for n, df in se.routes(spark, TINY, config)[1].items()}
    assert rows(se.SearchConfig(batch=3)) == rows(se.SearchConfig(batch=10**6))
    assert [b for label, b in seen if label in ("keyword", "vector")][:2] == ["3", "3"]


def test_vectors_are_read_by_few_tasks(spark):
    """Each task sends 100 rows a query on: not one task for each part of the shuffle that made the passages distinct."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set(name, "23")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        corpus = se.Corpus(spark, TINY)
        plan = physical(se.vector_route(corpus.evidence, se.materialize(se.known_item_queries(corpus), "q"), se.SearchConfig()))
    finally:
        spark.conf.set(name, old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "FileScan" in below
