import random

import numpy as np
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from lodestone.llm import leakage as lk
from lodestone.llm.fold import fold_text


def brute(docs, items, c=lk.LeakConfig()):
    out = {}
    for d, text in docs:
        text = fold_text(text or "")
        for i, item in items:
            if item is None or len(item) < c.min_chars:
                continue
            f = fold_text(item)
            n = lk._seed_length(f, c)
            covered = set()
            for k in range(len(f) - n + 1):
                if f[k : k + n] in text:
                    covered.update(range(k, k + n))
            if covered and len(covered) >= c.coverage * len(f):
                out[d, i] = len(covered)
    return out


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.integers(1, 3), min_size=1, max_size=80))
def test_suffix_array_is_sorted(codes):
    codes = np.array(codes, np.uint32)
    order = lk.suffix_array(codes, len(codes))
    suffixes = [codes[k:].tolist() for k in order]
    assert suffixes == sorted(suffixes)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(12)] + [(20, "显示器的面板一直报错，顶部键程落在中游；后置风道写满了，转轴处跑分从三变到五，怎样确认并且修复它才好呢？")]
    docs = []
    for k in range(60):
        filler = [rng.choice(words) for _ in range(80)]
        item = rng.choice(items)[1]
        cut = rng.choice([0, len(item) // 4, len(item) // 2, len(item)])
        docs.append((k, " ".join(filler[:40]) + item[:cut].upper().replace(" ", "\n") + " " + " ".join(filler[40:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = lk.leaked(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.covered for r in found.collect()}
    assert got == brute(docs, items) and got
    assert lk.without_leaks(df, found).count() == 60 - len({d for d, _ in got})
    places = {(r.doc_id, r.item_id): (r.longest, r.longest_at) for r in found.collect()}
    for (d, i), (longest, at) in places.items():
        folded, item = fold_text(dict(docs)[d]), fold_text(dict(items)[i])
        assert folded[at : at + longest] in item and not any(folded[k : k + longest + 1] in item for k in range(len(folded) - longest))
    several = lk.leaked(df, spark.createDataFrame(items, "item_id long, text string"), config=lk.LeakConfig(block=4))
    assert {(r.doc_id, r.item_id): r.covered for r in several.collect()} == got


def test_runs_of_one_character_take_linear_room(spark):
    docs = [(1, "0" * 1_000_000), (2, "0" * 100), (3, "ab" * 400), (4, "1" * 50)]
    items = [(1, "0" * 400), (2, "ab" * 300), (3, "0" * 90 + "1" * 400)]
    rows = lk.leaked(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.covered, r.longest) for r in rows} == {(1, 1): (400, 400), (2, 1): (400, 100), (3, 2): (600, 600), (4, 3): (400, 50)}


def test_longest_match(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    row = lk.leaked(spark.createDataFrame([(1, "xx " + text + " yy")], "doc_id long, text string"), spark.createDataFrame([(7, text)], "item_id long, text string")).first()
    assert row.longest == row.covered == row.item_chars == len(fold_text(text))


def test_dirt(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "。" * 50)], "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("doc", F.lit(0))
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "short"), (5, "。" * 60)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in lk.leaked(docs, items).collect()] == [(1, 1)]
    assert lk.leaked(docs.limit(0), items).count() == 0 and lk.leaked(docs, items.limit(0)).count() == 0
