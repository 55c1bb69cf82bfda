"""Problem 7: evaluation texts inside training texts, by suffix arrays over shards of the corpus.

Each shard of folded training texts gets one suffix array (suffixes sorted to the depth of the longest seed, by doubling: 4, 8, 16, 32
characters). Every suffix of every test text is looked up in it by binary search, which gives the interval of all places where at least a
seed's length of it stands verbatim. Suffixes with one beginning share one interval, and different ones have disjoint intervals, so that the
places of a shard are walked at most once however often a passage repeats. The characters of the test text that the seeds of a document cover
decide whether it leaks; for those that do, the longest verbatim match and its place come with it. Documents are never split over
shards, so the result needs no shuffle. Test texts come in blocks; beyond one block the suffix arrays are written once and every block is looked up in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.fold import fold_batch, fold_text
from lodestone.sources.tables import materialize

_SUB_CHARS = 1_500_000
_HITS = 4_000_000


@dataclass(frozen=True)
class LeakConfig:
    """seed_han, seed_other: least length of a verbatim match, for texts with at least a quarter of ideographs and for others.

    coverage: share of the folded test text that the matches must cover; min_chars: shorter test texts (as stored) are never found.
    block, block_chars: test texts a pass takes, and their characters; they do not bound what can be searched, more take more passes.
    """

    seed_han: int = 10
    seed_other: int = 24
    coverage: float = 0.42
    min_chars: int = 40
    block: int = 5_000
    block_chars: int = 2_000_000


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` (below 2**21) sorted by the ``depth`` or more characters that follow."""
    n = len(codes)
    alphabet, dense = np.unique(codes, return_inverse=True)
    dense = dense.astype(np.uint64) + 1
    padded = np.concatenate([dense, np.zeros(3, np.uint64)])
    if len(alphabet) < 65_535:
        key, h = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3], 4
    else:
        key, h = dense, 1
    while True:
        order = np.argsort(key, kind="stable")
        if h >= depth:
            return order
        ordered = key[order]
        new = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.uint64)]).astype(np.uint64)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        key = rank << np.uint64(32)
        key[: max(n - h, 0)] |= rank[h:]
        h *= 2


def _bound(codes: np.ndarray, order: np.ndarray, seeds: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all seeds (rows of equal length) at once: the first suffix not below (or above) each."""
    low, high = np.zeros(len(seeds), np.int64), np.full(len(seeds), len(order), np.int64)
    width = seeds.shape[1]
    step = np.arange(width)
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        text = padded[order[mid][:, None] + step]
        want = seeds[open_]
        differs = text != want
        first = differs.argmax(axis=1)
        row = np.arange(len(open_))
        same = ~differs[row, first]
        below = np.where(same, upper, text[row, first] < want[row, first])
        low[open_] = np.where(below, mid + 1, low[open_])
        high[open_] = np.where(below, high[open_], mid)


def _seed_length(folded: str, c: LeakConfig) -> int:
    han = sum("一" <= ch <= "鿿" for ch in folded)
    return c.seed_han if han >= 0.25 * len(folded) else c.seed_other


class _Seeds:
    """The seeds of a block of folded test texts: the different ones in groups of one length, and which texts hold each of them where."""

    def __init__(self, texts: list[str], c: LeakConfig):
        self.codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.size = np.array([_seed_length(t, c) for t in texts], np.int64)
        self.groups = []
        for size in np.unique(self.size).tolist():
            own = [k for k in np.flatnonzero(self.size == size).tolist() if len(self.codes[k]) >= size]
            if not own:
                continue
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(self.codes[k], size) for k in own])
            item = np.repeat(own, [len(self.codes[k]) - size + 1 for k in own])
            at = np.concatenate([np.arange(len(self.codes[k]) - size + 1) for k in own])
            _, first, which = np.unique(np.ascontiguousarray(windows).view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
            order = np.argsort(which, kind="stable")
            start = np.searchsorted(which[order], np.arange(len(first) + 1))
            self.groups.append((size, windows[first], start, item[order], at[order]))


def _covered(doc: np.ndarray, item: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, test text, characters of the test text under its seeds) from the seeds that stand in each document."""
    by = np.lexsort((at, item, doc))
    doc, item, at = doc[by], item[by], at[by]
    last = np.append((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True)
    gain = np.where(last, size[item], np.minimum(size[item], np.append(at[1:], 0) - at))
    stop = np.flatnonzero(last)
    return doc[stop], item[stop], np.diff(np.cumsum(gain)[stop], prepend=0)


def longest_match(text: np.ndarray, part: np.ndarray, least: int) -> tuple[int, int]:
    """(length, place in ``text``) of the longest common run of two texts that have one of ``least`` characters: its length is halved in on."""
    base = np.uint64(0x9E3779B97F4A7C15)

    def prefix(codes: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64)])

    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(len(text), len(part)), base))])
    whole, own = prefix(text), prefix(part)

    def place(size: int) -> int:
        many = [len(text) - size + 1, len(part) - size + 1]
        a, b = ((p[size:] - p[:-size]) * powers[: len(powers) - 1][max(many) - n : max(many)][::-1] for p, n in ((whole, many[0]), (own, many[1])))
        for at in np.flatnonzero(np.isin(a, b)).tolist():
            for other in np.flatnonzero(b == a[at]).tolist():
                if np.array_equal(text[at : at + size], part[other : other + size]):
                    return at
        return -1

    low, high, where = least, min(len(text), len(part)), place(least)
    while low < high:
        middle = (low + high + 1) // 2
        at = place(middle)
        low, high, where = (middle, high, at) if at >= 0 else (low, middle - 1, where)
    return low, where


def _shards(c: LeakConfig):
    """One row per shard: its documents, their folded characters (a 0 ends each) and where they begin, and the suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= _SUB_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                codes, offsets = fold_batch(texts[start:stop])
                count = stop - start
                spaced = np.zeros(len(codes) + count, np.uint32)
                spaced[np.arange(len(codes)) + np.repeat(np.arange(count), np.diff(offsets))] = codes
                order = suffix_array(spaced, max(c.seed_han, c.seed_other))
                docs = pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), batch.column(0).slice(start, count))
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (spaced, (offsets + np.arange(count + 1)).astype(np.int64), order.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([docs, *blobs], names=["docs", "codes", "starts", "suffixes"])
                start = stop

    return run


def _lookup(c: LeakConfig, block, kind: pa.DataType):
    """The leaks of a block of test texts in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _Seeds(block.value["texts"], c)
        ids = pa.array(block.value["ids"], kind)
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs").slice(row, 1).flatten()
                codes, starts, order = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in (("codes", np.uint32), ("starts", np.int64), ("suffixes", np.uint32)))
                found = []
                for size, windows, start, item, at in seeds.groups:
                    low, high = _bound(codes, order, windows, False), _bound(codes, order, windows, True)
                    many = high - low
                    place = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    doc = np.searchsorted(starts, place, side="right") - 1
                    pair = np.unique(doc.astype(np.int64) << 32 | np.repeat(np.arange(len(many)), many))  # a seed counts once in a document
                    doc, seed = pair >> 32, pair & 0xFFFFFFFF
                    uses = np.diff(start)[seed]
                    total, first = np.cumsum(uses), 0
                    while first < len(doc):  # whole documents, some _HITS uses of seeds at a time
                        last = int(np.searchsorted(total, (total[first - 1] if first else 0) + _HITS, side="right"))
                        last = int(np.searchsorted(doc, doc[max(last - 1, first)], side="right"))
                        n = uses[first:last]
                        use = np.repeat(start[seed[first:last]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        d, i, covered = _covered(np.repeat(doc[first:last], n), item[use], at[use], seeds.size)
                        ok = covered >= c.coverage * seeds.length[i]
                        found += zip(d[ok].tolist(), i[ok].tolist(), covered[ok].tolist(), [size] * int(ok.sum()))
                        first = last
                matches = [longest_match(codes[starts[d] : starts[d + 1] - 1], seeds.codes[i], size) for d, i, _, size in found]
                out = [docs.take(pa.array([f[0] for f in found], pa.int64())), ids.take(pa.array([f[1] for f in found], pa.int64()))]
                numbers = ([f[2] for f in found], [int(seeds.length[f[1]]) for f in found], [m[0] for m in matches], [m[1] for m in matches])
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(n, pa.int64()) for n in numbers)], names=["doc", "item", "covered", "item_chars", "longest", "longest_at"])

    return run


def _blocks(tests: DataFrame, c: LeakConfig) -> Iterator[dict]:
    """The folded test texts, a block at a time: the driver never holds more than one."""
    ids, texts, chars = [], [], 0
    for row in tests.orderBy("item", "text").toLocalIterator():
        folded = fold_text(row.text)
        if len(folded) < min(c.seed_han, c.seed_other):
            continue
        if ids and (len(ids) == c.block or chars + len(folded) > c.block_chars):
            yield {"ids": ids, "texts": texts}
            ids, texts, chars = [], [], 0
        ids.append(row.item)
        texts.append(folded)
        chars += len(folded)
    yield {"ids": ids, "texts": texts}


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", config: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id, covered, item_chars, longest, longest_at): each document with each test text it leaks.

    covered and item_chars count folded characters, longest is the longest verbatim match, longest_at its place in the folded document. Null and
    empty texts on either side, test texts under min_chars, and such with fewer folded characters than a seed give no rows. Repeated rows
    count once. The test texts come to the driver a block at a time; the documents never do. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, c = documents.sparkSession, config
    tests = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter(F.char_length("text") >= c.min_chars).distinct()
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).filter("text IS NOT NULL AND text <> ''")
    doc_kind, item_kind = docs.schema["doc"].dataType, tests.schema["item"].dataType
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(tests, c)]
    schema = f"doc {doc_kind.simpleString()}, item {item_kind.simpleString()}, covered long, item_chars long, longest long, longest_at long"
    build, look = _shards(c), [_lookup(c, b, to_arrow_type(item_kind)) for b in blocks]
    if len(blocks) == 1:
        parts = [docs.mapInArrow(lambda batches: look[0](build(batches)), schema)]
    else:
        shards = materialize(docs.mapInArrow(build, f"docs array<{doc_kind.simpleString()}>, codes binary, starts binary, suffixes binary"), "suffixes")
        parts = [shards.mapInArrow(one, schema) for one in look]
    names = ("covered", "item_chars", "longest", "longest_at")
    found = reduce(DataFrame.unionByName, parts).groupBy("doc", "item").agg(F.max(F.struct(*names)).alias("m"))
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), *(F.col("m")[n].alias(n) for n in names))


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``documents`` without those that leak; all columns and repeated rows stay."""
    return documents.join(found.select(doc_id).distinct(), doc_id, "left_anti")
