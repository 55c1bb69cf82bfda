import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import vectors as vs


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((20, width))
    return centre[rng.integers(0, 20, n)] + 0.7 * rng.standard_normal((n, width))


def frame(spark, x, ids=None):
    return spark.createDataFrame([(ids[k] if ids else f"v{k:05}", [float(a) for a in r]) for k, r in enumerate(x)], "id string, embedding array<double>")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_against_brute_force(spark):
    x = clustered(3000, 64, 1)
    got = vs.nearest_vectors(frame(spark, x), "id", "embedding", vs.VectorConfig(k=10, list_rows=50, partition_rows=400)).collect()
    _, top = brute(x, 10)
    want = {(f"v{a:05}", f"v{b:05}") for a, row in enumerate(top) for b in row}
    found = {(r.id, r.neighbour) for r in got}
    assert len(found & want) / len(want) >= 0.9 and max(r["rank"] for r in got) == 10 and len(got) == 30_000


def test_recall_holds_with_many_lists(spark):
    x = clustered(6000, 64, 11)
    s, top = brute(x, 10)
    want = {(f"v{a:05}", f"v{b:05}") for a in range(0, 6000, 20) for b in top[a]}
    got = vs.nearest_vectors(frame(spark, x), "id", "embedding", vs.VectorConfig(k=10, list_rows=10, partition_rows=400), F.substring("id", 2, 5).cast("int") % 20 == 0).collect()
    assert len({(r.id, r.neighbour) for r in got} & want) / len(want) >= 0.97 and len(got) == 3000


def test_floor_reads_all_lists_that_may_hold_one(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((2000, 64))
    x = np.concatenate([x, x + 0.44 * rng.standard_normal(x.shape)])
    s, _ = brute(x, 1)
    want = {tuple(sorted((f"v{a:05}", f"v{b:05}"))) for a, b in zip(*np.nonzero(s >= 0.9))}
    got = vs.nearest_vectors(frame(spark, x), "id", "embedding", vs.VectorConfig(k=10, probes=1, floor=0.9, list_rows=10, partition_rows=100)).collect()
    found = {tuple(sorted((r.id, r.neighbour))) for r in got}
    assert len(want) > 1000 and found <= want and len(found) / len(want) >= 0.999


def test_floor_finds_the_close_ones(spark):
    x = clustered(1500, 64, 2)
    x[1000:1200] = x[:200] * 3 + 0.1 * np.random.default_rng(3).standard_normal((200, 64))
    s, _ = brute(x, 1)
    want = {tuple(sorted((f"v{a:05}", f"v{b:05}"))) for a, b in zip(*np.nonzero(s >= 0.9))}
    got = vs.nearest_vectors(frame(spark, x), "id", "embedding", vs.VectorConfig(k=10, probes=4, floor=0.9, list_rows=50)).collect()
    assert {tuple(sorted((r.id, r.neighbour))) for r in got} == want and len(want) >= 200


def test_a_hot_group_of_copies(spark):
    x = np.concatenate([np.tile(np.arange(1.0, 65.0), (60, 1)), clustered(120, 64, 5)])
    got = vs.nearest_vectors(frame(spark, x), "id", "embedding", vs.VectorConfig(k=3, list_rows=20)).filter("cosine > 0.999999").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.neighbour)
    assert len(by) == 60 and sorted(by["v00000"]) == ["v00001", "v00002", "v00003"] and sorted(by["v00050"]) == ["v00000", "v00001", "v00002"]


def test_equal_vectors_are_one_class_however_they_are_batched(spark):
    x = np.concatenate([np.tile(np.arange(1.0, 65.0), (45, 1)), np.tile(np.arange(64.0, 0.0, -1.0) * 3, (23, 1)), clustered(50, 64, 6)])
    order = np.random.default_rng(9).permutation(len(x))
    df = frame(spark, x[order], [f"v{k:05}" for k in order])
    want = None
    for parts in (1, 4, 7):
        got = vs.nearest_vectors(df.repartition(parts), "id", "embedding", vs.VectorConfig(k=3, list_rows=20, partition_rows=16)).collect()
        rows = {(r.id, r.neighbour, r["rank"]) for r in got}
        assert len(rows) == 3 * len(x) and {n for i, n, _ in rows if i == "v00044"} == {"v00000", "v00001", "v00002"} and {n for i, n, _ in rows if i == "v00045"} == {"v00046", "v00047", "v00048"}
        assert want is None or rows == want
        want = rows


def test_floor_with_a_query_set_keeps_the_askers_pairs(spark):
    x = clustered(900, 64, 13)
    x[600:] = x[:300] + 0.15 * np.random.default_rng(14).standard_normal((300, 64))
    s, _ = brute(x, 1)
    want = {(f"v{a:05}", f"v{b:05}") for a, b in zip(*np.nonzero(s >= 0.9)) if a % 20 == 0}
    got = vs.nearest_vectors(frame(spark, x), "id", "embedding", vs.VectorConfig(k=10, floor=0.9, list_rows=10, partition_rows=60), F.substring("id", 2, 5).cast("int") % 20 == 0).collect()
    assert {(r.id, r.neighbour) for r in got} == want and len(want) >= 30


def test_dirt_query_set_and_empty(spark):
    good = [1.0] + [0.0] * 63
    rows = [("a", good), ("a", good), ("b", [2.0] + [0.01] * 63), ("n", None), ("e", []), ("z", [0.0] * 64), ("w", [1.0] * 63), ("q", [float("nan")] * 64), ("i", [float("inf")] * 64), ("h", [None] + [1.0] * 63), ("big", [1e308] * 64), (None, good)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").withColumn("vec", F.lit(1)).withColumn("rep", F.lit("x"))
    got = {(r.id, r.neighbour) for r in vs.nearest_vectors(df, "id", "embedding").collect()}
    assert got == {(x, y) for x in ("a", "b", "big") for y in ("a", "b", "big") if x != y}
    assert {r.id for r in vs.nearest_vectors(df, "id", "embedding", queries=F.col("id") == "b").collect()} == {"b"}
    assert vs.nearest_vectors(df.filter("id = 'n'"), "id", "embedding").count() == 0


def test_scan_abandons_only_the_far():
    x = clustered(400, 64, 7).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x @ vs.rotation(64, 1)
    i, j, d = vs.adaptive_scan(x[:50], x, np.full(50, 0.5, np.float32), vs.VectorConfig())
    exact = ((x[:50, None] - x[None]) ** 2).sum(axis=2)
    near = {(a, b) for a, b in zip(*np.nonzero(exact <= 0.5))}
    assert len(near & set(zip(i.tolist(), j.tolist()))) >= 0.99 * len(near) and np.allclose(d, exact[i, j], atol=1e-4)
