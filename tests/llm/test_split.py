from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from lodestone.llm.split import cut_batch, split_items


def check(text, target, overlap, pieces):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert 0 < b - a <= target
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        room = min(overlap, target - 1)
        assert a < c <= b < d and room <= b - c <= 2 * room


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.text(alphabet="ab。，.\n 中́‍👩", min_size=1, max_size=300), min_size=1, max_size=4), hs.integers(8, 60), hs.integers(0, 70))
def test_pieces_cover_with_overlap(texts, target, overlap):
    for text, pieces in zip(texts, cut_batch(texts, [target] * len(texts), [overlap] * len(texts))):
        check(text, target, overlap, pieces)


def test_the_specified_overlap_holds_above_a_quarter():
    for overlap in (10, 11, 20, 30, 39):
        for text in ("x" * 500, "word " * 100, "一句话。" * 120):
            (pieces,) = cut_batch([text], [40], [overlap])
            check(text, 40, overlap, pieces)


def test_doubling_equals_walking():
    text = "".join(f"sentence number {k}. " + ("\n\n" if k % 7 == 0 else "") for k in range(2000))
    (pieces,) = cut_batch([text], [200], [30])
    alone = []
    at = 0
    while at < len(text):  # the same greedy rule, one piece at a time
        (rest,) = cut_batch([text[at:]], [200], [30])
        alone.append((at, at + rest[0][1]))
        if len(rest) == 1:
            break
        at += rest[1][0]
    assert pieces == alone


def test_natural_boundaries_come_first():
    text = "a" * 150 + "。" + "b" * 30 + "，" + "c" * 100
    (pieces,) = cut_batch([text], [200], [0])
    assert pieces[0] == (0, 151)


def test_table_and_dirt(spark):
    rows = [(1, "x" * 50, 20, 5), (1, "x" * 50, 20, 5), (2, None, 20, 5), (3, "", 20, 5), (4, "y" * 20, 20, 5), (5, "z" * 30, None, 5), (6, "w" * 30, 20, None), (7, "v" * 10, 0, 3), (8, "u" * 200_000, 300, 30)]
    df = spark.createDataFrame(rows, "id int, text string, target int, overlap int").withColumn("piece", F.lit(0)).withColumn("piece_no", F.lit(0))
    got = split_items(df, ["id"], "text", "target", "overlap").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.piece_start, r.piece_end))
    assert set(by) == {1, 6, 7, 8} and len(by[7]) == 10
    for k, t in ((6, 30), (8, 200_000)):
        check("?" * t, 20 if k == 6 else 300, 0 if k == 6 else 30, sorted(by[k]))
    assert split_items(df.limit(0), ["id"], "text", "target", "overlap").count() == 0
