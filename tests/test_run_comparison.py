"""run_comparison: both fusion constants at once, with the rows of one run for each; and what its routes move."""

import random
import re

import pytest

import __spark_entry__ as e
from lodestone.operators import evaluation as ev, retrieval as rt
from lodestone.plans import search as se

TINY = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_ranks_are_those_of_one_run_for_each_constant(spark, seed):
    rng = random.Random(seed)
    queries = spark.createDataFrame([(f"q{q}",) for q in range(12)], "query_id string")
    children = spark.createDataFrame([(f"e{i:02}", f"c{rng.randrange(15):02}") for i in range(60)], "id string, context_id string")
    route = lambda: spark.createDataFrame([(f"q{q}", f"e{i:02}", 0.0, n) for q in range(10) for n, i in enumerate(rng.sample(range(60), 25), 1)], "query_id string, id string, score double, rank int")
    routes = {"keyword": route(), "vector": route()}
    judged = spark.createDataFrame([(f"q{q}", f"c{c:02}", rng.randrange(3)) for q in range(1, 11) for c in rng.sample(range(20), 3)], "query_id string, context_id string, grade int")
    got = {r.query_id: (r.rank_20, r.rank_60) for r in rt.first_ranks_by_constant(routes, children, judged, queries, "id", "context_id", (20, 60)).collect()}
    want = []
    for k in (20, 60):
        ranked = rt.group_parents(rt.fuse(routes, "id", k), children, "id", "context_id", 1000)
        want.append({r.query_id: r.rank for r in ev.first_relevant(ranked, judged, queries, "context_id").collect()})
    assert len(got) == 12 and got == {q: (want[0][q], want[1][q]) for q in want[0]}
    assert got["q0"] == got["q11"] == (None, None) and any(a for a, _ in got.values())


def test_a_tie_goes_to_the_smaller_parent_and_a_query_moves_once(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    keyword = frame([("q", "e1", 1.0, 1), ("q", "e2", 0.5, 2)], "query_id string, id string, score double, rank int")
    vector = frame([("q", "e2", 1.0, 1), ("q", "e1", 0.5, 2)], "query_id string, id string, score double, rank int")
    children = frame([("e1", "b"), ("e2", "a")], "id string, context_id string")
    out = rt.first_ranks_by_constant({"keyword": keyword, "vector": vector}, children, frame([("q", "b", 1), ("q", "a", 0)], "query_id string, context_id string, grade int"), frame([("q",)], "query_id string"), "id", "context_id", (20, 60))
    assert list(map(tuple, out.collect())) == [("q", 2, 2)]


def test_evidence_is_read_once_behind_the_routes(spark):
    """Once for both constants, and neither maps nor lists of ranks are made."""
    plan = physical(e.queries()["run_comparison"](spark, TINY))
    assert len(re.findall(r"FileScan parquet [^\n]*evidence_unit", plan)) == 1
    assert "collect_list" not in plan and "min(struct" not in plan


def test_texts_and_vectors_are_moved_once(spark, monkeypatch):
    """The scope is looked up by ids: bodies and vectors stay where they were made distinct."""
    name, plans, write = "spark.sql.autoBroadcastJoinThreshold", {}, se.materialize
    monkeypatch.setattr(se, "materialize", lambda df, label="t": (plans.update({label: physical(df)}), write(df, label))[1])
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        se.routes(spark, TINY)
    finally:
        spark.conf.set(name, old)
    for label, column in (("terms", "body"), ("vectors", "embedding")):
        side = plans[label][: plans[label].index("FileScan")]  # from the top to the scan of the passages
        assert f"first({column}#" in side and side.count("Exchange") == 1 and side.count("Sort [") == 1
