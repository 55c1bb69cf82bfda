import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from lodestone.functions import conditions as cond, text as tx
from lodestone.operators import evaluation as ev, reconcile as rc, retrieval as rt, structure as st
from lodestone.streaming import upsert
from lodestone.streaming.windows import hourly


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_bm25_by_hand(spark):
    docs = rt.with_terms(spark.createDataFrame([("a", "fan noise fan"), ("b", "battery"), ("c", ""), ("d", None)], "id string, body string"), "id", F.col("body"))
    queries = spark.createDataFrame([("q", ["fan", "fan", "missing"])], "query_id string, terms array<string>")
    got = rt.bm25(docs, queries, "id").collect()
    average, idf = 4 / 4, math.log(1 + (4 - 1 + 0.5) / (1 + 0.5))
    assert [(r.id, round(r.score, 9)) for r in got] == [("a", round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / average)), 9))]


def test_tokens_and_pieces(spark):
    df = spark.createDataFrame([("The USB-C port of C++ 显示器 卡 RTX4060",)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == ["usb-c", "port", "c++", "rtx4060", "显示", "示器", "卡"]
    assert df.select(tx.model_pieces(F.lit("RTX4060"))).first()[0] == ["rtx4060", "rtx", "4060"]


def test_fusion_scores_best_ranks(spark):
    one = spark.createDataFrame([("q", "x", 2, 0.5), ("q", "x", 5, 0.4), ("q", "y", 1, 0.9)], "query_id string, id string, rank int, score double")
    two = spark.createDataFrame([("q", "x", 1, 0.9)], "query_id string, id string, rank int, score double")
    got = {r.id: (r.score, r.ranks) for r in rt.fuse({"keyword": one, "vector": two}, "id", 60).collect()}
    assert got["x"] == (round(1 / 62 + 1 / 61, 8), {"keyword": 2, "vector": 1}) and got["y"][0] == round(1 / 61, 8)


def test_cosine_blocks_agree_and_ties_go_to_the_smaller_id(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])], "id string, v array<double>")
    queries = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 3.0])], "query_id string, v array<double>")
    whole, split = (rows(rt.cosine_topk(vectors, queries, "id", 2, block=n)) for n in (10, 1))
    assert whole == split and [r[:2] for r in whole] == [("p", "a"), ("p", "b"), ("q", "a"), ("q", "c")]
    assert rows(rt.cosine_topk(vectors, queries.limit(0), "id", 2)) == []


def test_vector_validity(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [None, 1.0]), (7, [float("inf"), 1.0])], "i int, v array<double>")
    assert [r.i for r in df.filter(rt.valid_vector(F.col("v"), 2)).collect()] == [1]


def test_three_values(spark):
    df = spark.createDataFrame([(1, 1.2, None, False), (2, None, "X", True), (3, 2.0, None, None)], "id int, weight double, gpu string, has_gpu boolean")
    c = {"light": cond.at_most("weight", 1.5), "gpu": cond.one_of("gpu", ["X"], known_false=~F.col("has_gpu"))}
    assert rows(cond.evaluate(df, c), "id", "c_light", "c_gpu") == [(1, True, False), (2, None, True), (3, False, None)]
    assert rows(cond.diagnostics(df, c)) == [("gpu", 3, 1, 1, 1), ("light", 3, 1, 1, 1)]
    assert rows(cond.unknown_counts(df, {n: (n, x) for n, x in c.items()})) == [("light", 1)]
    assert cond.matching(df, {}).count() == 3


def test_upsert_keeps_ids_and_is_idempotent(spark):
    schema = "id string, key string, digest string, updated_at long"
    stored = spark.createDataFrame([("1", "a", "x", 1), ("2", "b", "y", 1), ("3", "z", "q", 1)], schema)
    incoming = spark.createDataFrame([("9", "a", "x", 2), ("8", "b", "new", 2), ("7", "c", "n", 2)], schema)
    assert dict(rows(rc.upsert_plan(incoming, stored, ["key"], "digest"))) == {"a": "unchanged", "b": "updated", "c": "created", "z": "absent"}
    after = rc.apply_upsert(incoming, stored, ["key"], "digest")
    assert rows(after, "id", "key", "digest") == [("1", "a", "x"), ("2", "b", "new"), ("3", "z", "q"), ("7", "c", "n")]
    assert rows(rc.apply_upsert(incoming, after, ["key"], "digest"), "id", "key", "digest") == rows(after, "id", "key", "digest")


def test_difference_treats_null_as_a_value(spark):
    new = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, v string")
    old = spark.createDataFrame([(1, None), (2, None), (4, "d")], "k int, v string")
    assert rows(rc.difference(new, old, "k", ["v"])) == [(1, "unchanged", []), (2, "updated", ["v"]), (3, "created", None), (4, "deleted", None)]


def test_longest_prefix(spark):
    items = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, ["x"]), (4, [])], "id int, path array<string>")
    rules = spark.createDataFrame([(["a"], "A"), (["a", "b"], "AB")], "prefix array<string>, category string")
    assert rows(rc.longest_prefix(items, F.col("path"), rules, "id")) == [(1, "AB"), (2, "A"), (3, None), (4, None)]


def test_graded_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item string, rank int")
    judged = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("r", "z", 1), ("s", "y", 0)], "query_id string, item string, grade int")
    got = {r.query_id: r for r in ev.graded(ranked, judged, "item").collect()}
    ideal = 3 + 1 / math.log2(3)
    assert got["q"].ndcg == round((1 + 3 / math.log2(4)) / ideal, 6) and got["q"].p == 1.0 and got["r"].ndcg == 0 and got["s"].ndcg is None


def test_sections_and_islands(spark):
    text = "lead\n# One\n| a |\n| b |\nx\n| c |\n## Two\r\nend"
    lines = st.text_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), "doc_id", "text")
    assert rows(st.sections(lines, "doc_id")) == [(1, 0, None, 1, 1), (1, 1, "One", 2, 6), (1, 2, "Two", 7, 8)]
    assert rows(st.islands(lines, "doc_id", "table")) == [(1, 3, 4, 2), (1, 6, 6, 1)]


def test_html_blocks(spark):
    page = "<head><title>t</title></head><h2>Top</h2><p>a<br>b &amp; c</p><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>  k\n</pre><script>no</script>"
    got = rows(st.html_blocks(spark.createDataFrame([(1, page), (2, ""), (3, None)], "id int, html string"), "id", "html"))
    assert [r[2:] for r in got] == [("heading", 2, "Top"), ("paragraph", 0, "a b & c"), ("list", 0, "x"), ("table", 0, "| 1 | 2 |"), ("code", 0, "  k")]


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.tuples(hs.integers(1, 500), hs.sampled_from(["text", "heading"])), max_size=20))
def test_packing_covers_every_block_once(sizes):
    blocks, at = [], 0
    for n, kind in sizes:
        blocks.append((at, at + n, kind))
        at += n + 2
    runs = st.pack_blocks(blocks, 400, 120)
    assert [k for a, b in runs for k in range(a, b + 1)] == list(range(len(blocks)))


def test_passages_are_substrings(spark):
    text = "# T\n\nshort\n\n" + "word " * 100 + "\n\nend"
    for r in st.passages(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), "id", "text").collect():
        assert text[r.char_start : r.char_end] == r.body


def test_streaming_upsert_equals_batch(spark, tmp_path):
    schema = "id string, key string, digest string, updated_at long"
    source = str(tmp_path / "drop")
    spark.createDataFrame([("1", "a", "x", 1), ("2", "b", "y", 1), ("2", "b", "y2", 2)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    upsert.start(stream(), str(tmp_path / "snap"), ["key"], "digest", "updated_at", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("5", "b", "z", 3), ("6", "c", "w", 3)], schema).write.mode("append").parquet(source)
    upsert.start(stream(), str(tmp_path / "snap"), ["key"], "digest", "updated_at", str(tmp_path / "cp")).awaitTermination()
    assert rows(upsert.read_snapshot(spark, str(tmp_path / "snap")), "id", "key", "digest") == [("1", "a", "x"), ("2", "b", "z"), ("6", "c", "w")]


def test_streaming_windows_equal_batch(spark, tmp_path):
    events = spark.range(200).selectExpr("timestamp_seconds(1700000000 + id * 97) AS ts", "concat('t', id % 3) AS event_type", "cast(id AS double) AS value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = hourly(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("hours")) == rows(hourly(events))


class _Sent:
    def __init__(self, value):
        self.value = value


def _peak_mb(run, batch):
    """Rows of one batch, and the most memory that arrays took meanwhile."""
    import tracemalloc

    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_keyword_scores_of_a_full_block_of_queries_stay_small():
    """2,000 queries that share three terms with 2,000 documents: 12 million products, which were all held at once."""
    n, words = 2000, ["a", "b", "c"]
    place = np.sort((np.arange(3, dtype=np.int64)[:, None] << 32 | np.arange(n)).ravel())
    sent = _Sent((pa.array([f"q{k}" for k in range(n)]), {w: k for k, w in enumerate(words)}, place, np.ones(3), 3.0))
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(n)]), pa.array([words + ["a"] * (k % 7) for k in range(n)]), pa.array([3 + k % 7 for k in range(n)])], names=["id", "terms", "length"])
    rows, peak = _peak_mb(rt._score_batches(sent, "id", 1, 6, 1.5, 0.75), batch)
    assert rows >= n and peak < 120


def test_cosines_of_a_full_block_of_queries_stay_small():
    """4,096 queries against 4,000 vectors: 16 million cosines, which were all held at once."""
    made = np.random.default_rng(1)
    sent = _Sent(([f"q{k}" for k in range(4096)], made.normal(size=(4096, 4))))
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(4000)]), pa.array(made.normal(size=(4000, 4)).tolist())], names=["id", "v"])
    rows, peak = _peak_mb(rt._cosine_batches(sent, "id", 1), batch)
    assert rows >= 4096 and peak < 120


def test_runs_of_queries_change_no_score():
    made = np.random.default_rng(2)
    terms = [[f"t{x}" for x in made.integers(0, 9, made.integers(0, 6))] for _ in range(50)]
    number = {f"t{k}": k for k in range(9)}
    asked = [sorted(set(made.integers(0, 9, 3).tolist())) for _ in range(30)]
    sent = _Sent((pa.array([f"q{k}" for k in range(30)]), number, np.sort(np.array([t << 32 | q for q, own in enumerate(asked) for t in own], dtype=np.int64)), np.arange(1.0, 10.0), 2.5))
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(50)]), pa.array(terms, pa.list_(pa.string())), pa.array([len(t) for t in terms])], names=["id", "terms", "length"])
    for k in (None, 3):
        got = [sorted(tuple(r.values()) for b in rt._score_batches(sent, "id", k, 6, 1.5, 0.75, cells)(iter([batch])) for r in b.to_pylist()) for cells in (1, 300, 10**6)]
        assert got[0] == got[1] == got[2]
        for q, own in enumerate(asked):
            score = {}
            for d, t in enumerate(terms):
                s = round(sum((x + 1) * t.count(f"t{x}") * 2.5 / (t.count(f"t{x}") + 1.5 * (0.25 + 0.75 * len(t) / 2.5)) for x in own), 6)
                if s > 0:
                    score[f"d{d}"] = s
            edge = sorted(score.values())[-k:][0] if k and score else 0
            assert {(i, s) for a, i, s in got[0] if a == f"q{q}"} == {(i, s) for i, s in score.items() if s >= edge}


def _keyword_batches(made, docs, words, batches, asked):
    """Documents of random words in batches, queries of ``asked`` word numbers, and the brute force scores by query."""
    terms = [[f"t{x}" for x in made.integers(0, words, made.integers(0, 6))] for _ in range(docs)]
    place = np.sort(np.array([t << 32 | q for q, own in enumerate(asked) for t in own], dtype=np.int64))
    sent = _Sent((pa.array([f"q{k}" for k in range(len(asked))]), {f"t{k}": k for k in range(words)}, place, np.arange(1.0, words + 1), 2.5))
    whole = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(docs)]), pa.array(terms, pa.list_(pa.string())), pa.array([len(t) for t in terms])], names=["id", "terms", "length"])
    true = []
    for own in asked:
        score = {f"d{d}": round(sum((x + 1) * t.count(f"t{x}") * 2.5 / (t.count(f"t{x}") + 1.5 * (0.25 + 0.75 * len(t) / 2.5)) for x in own), 6) for d, t in enumerate(terms)}
        true.append({d: s for d, s in score.items() if s > 0})
    return sent, [whole.slice(at, -(-docs // batches)) for at in range(0, docs, -(-docs // batches))], true


def test_a_task_keeps_the_best_of_all_its_batches():
    """Each batch sent its own k best of each query on: 20 batches, 20 times the rows, all of which the JVM sorted."""
    made = np.random.default_rng(3)
    asked = [sorted(set(made.integers(0, 40, 3).tolist())) for _ in range(50)]
    sent, batches, true = _keyword_batches(made, 2000, 40, 20, asked)
    got = [r for b in rt._score_batches(sent, "id", 5, 6, 1.5, 0.75)(iter(batches)) for r in b.to_pylist()]
    edges = [sorted(s.values())[-min(5, len(s)) :][:1] for s in true]
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == {(f"q{q}", d, v) for q, s in enumerate(true) for d, v in s.items() if v >= edges[q][0]}
    assert len(got) == len({(r["query_id"], r["id"]) for r in got})

    x, y = made.normal(size=(2000, 4)), made.normal(size=(30, 4))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    vectors = [pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(at, at + 100)]), pa.array(x[at : at + 100].tolist())], names=["id", "v"]) for at in range(0, 2000, 100)]
    got = [r for b in rt._cosine_batches(_Sent(([f"q{k}" for k in range(30)], y)), "id", 5)(iter(vectors)) for r in b.to_pylist()]
    cosine = np.round(y @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
    assert {(r["query_id"], r["id"]) for r in got} == {(f"q{q}", f"d{d}") for q, d in zip(*np.nonzero(cosine >= np.sort(cosine, axis=1)[:, -5, None]))}


def test_leaders_of_many_ties_leave_early_and_none_is_lost():
    made = np.random.default_rng(4)
    sent, batches, true = _keyword_batches(made, 1500, 2, 15, [[0], [1], [0, 1]])
    for cells in (7, 900, 10**6):
        got = [(r["query_id"], r["id"], r["score"]) for b in rt._score_batches(sent, "id", 3, 6, 1.5, 0.75, cells)(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got))
        for q, s in enumerate(true):
            own = {(d, v) for a, d, v in got if a == f"q{q}"}
            assert own <= set(s.items()) and own >= {(d, v) for d, v in s.items() if v >= sorted(s.values())[-3]}


def test_a_batch_of_long_documents_is_scored_in_parts():
    """400 documents of 5,000 terms: two million at once took their arrays before."""
    place = np.arange(50, dtype=np.int64) << 32
    sent = _Sent((pa.array(["q"]), {f"t{k}": k for k in range(50)}, place, np.ones(50), 5000.0))
    flat = pa.array([f"t{k % 50}" for k in range(2_000_000)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 5000, dtype=np.int32)), flat)
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{k}" for k in range(400)]), lists, pa.array([5000] * 400)], names=["id", "terms", "length"])
    rows, peak = _peak_mb(rt._score_batches(sent, "id", 10, 6, 1.5, 0.75), batch)
    assert rows == 400 and peak < 30
