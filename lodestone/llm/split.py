"""Problem 4: splitting oversized items at natural boundaries by pointer doubling.

Every position of a text has one successor: the start of the next piece if a piece starts there. The piece's end is the
farthest boundary of the strongest kind in the second half of the room, or beyond the overlap if that is longer (blank line, line end, sentence
end, clause end, space; else a cut between two characters); the next start lies the overlap before that end, or at the last
boundary before that within once more the overlap. All successors of a batch of texts are found at once from running maxima; the table of
successors is then joined with itself (2, 4, 8, ... steps), and after log2(pieces) rounds the starts reachable from each
text's first position are known: all greedy cuts at once, without walking any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame, functions as F

_SUB_CHARS = 1_000_000

# Characters after which a text may be cut, by strength.
_SENTENCE = "。！？；!?;…"
_CLAUSE = "，、：,:"


@lru_cache(1)
def _extending() -> np.ndarray:
    """Code points that must stay with the one before: marks, joiners, variation selectors, skin tones."""
    out = np.zeros(0x20000, dtype=bool)
    for code in range(0x300, len(out)):
        if unicodedata.category(chr(code)) in ("Mn", "Me", "Mc"):
            out[code] = True
    out[[0x200D]] = True
    out[0x1F3FB:0x1F400] = True
    return out


def _last(flag: np.ndarray) -> np.ndarray:
    """For each position the last flagged one up to it, else -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def successors(codes: np.ndarray, first: np.ndarray, last: np.ndarray, target: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of the piece, start of the next one) for a piece at each position.

    codes: code points of texts end to end; first, last, target, overlap: of the text of each position. At the last piece of a text the next
    start is the text's end (== last), which is its own successor only as long as no other text begins there.
    """
    n = len(codes)
    here = np.arange(n)
    is_in = lambda chars: np.isin(codes, np.array([ord(c) for c in chars], dtype=codes.dtype))
    newline, space = codes == 10, is_in(" \t　")
    dot = (codes == 46) & np.concatenate([np.isin(codes[1:], [32, 10]), [True]])
    after = [newline & np.concatenate([[False], newline[:-1]]), newline, is_in(_SENTENCE) | dot, is_in(_CLAUSE), space]
    cut = lambda flag: np.concatenate([[False], flag])  # noqa: E731  # a cut at p lies before character p
    levels = [_last(cut(f)) for f in after]
    natural = _last(cut(np.logical_or.reduce(after)))
    extends = np.where(codes < 0x20000, _extending()[np.minimum(codes, 0x1FFFF)], False)
    joined = extends | np.concatenate([[False], codes[:-1] == 0x200D])
    safe = _last(np.append(~joined, True))
    limit = here + target
    room = np.minimum(overlap, target - 1)  # else no piece would get on
    least = here + np.maximum(target // 2, room)  # an end beyond it leaves the next piece something new
    end = np.full(n, -1)
    for level in levels:
        at = level[np.minimum(limit, last)]
        end = np.where((end < 0) & (at > least), at, end)
    hard = safe[np.minimum(limit, last)]
    hard = np.where(hard > least, hard, np.minimum(limit, last))
    end = np.where(end < 0, hard, end)
    end = np.where(last <= limit, last, end)
    want = np.maximum(end - room, 0)
    at = natural[want]
    hard = safe[want]
    low = np.maximum(end - 2 * room, (here + want + 1) // 2)  # natural, but not so early that pieces hardly get on
    start = np.where(at >= low, at, np.where(hard >= low, hard, want))
    start = np.where(end >= last, last, np.maximum(start, here + 1))
    return end, start


def cut_batch(texts: list[str], targets: list[int], overlaps: list[int]) -> list[list[tuple[int, int]]]:
    """The pieces (start, end) of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(lengths + 1)  # one more position per text: its end, the fixed point of its successors
    begins = stops - lengths - 1
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    spread = lambda a: np.repeat(np.asarray(a, dtype=np.int64), lengths + 1)
    last = spread(stops - 1)
    end, jump = successors(codes, spread(begins), last, np.maximum(spread(targets), 1), spread(overlaps))
    fixed = stops - 1
    jump[fixed] = fixed
    reached = begins
    while True:
        more = np.unique(np.concatenate([reached, jump[reached]]))
        if len(more) == len(reached):
            break
        reached, jump = more, jump[jump]
    reached = reached[reached != last[reached]]
    of = np.searchsorted(stops, reached, side="right")
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, s, e in zip(of.tolist(), reached.tolist(), end[reached].tolist()):
        out[k].append((s - int(begins[k]), e - int(begins[k])))
    return out


def split_items(df: DataFrame, key_cols: list[str], text_col: str, target_col: str, overlap_col: str) -> DataFrame:
    """Pieces of the items of ``df`` that are longer than their target.

    Returns key_cols, piece_no (from 0), piece_start, piece_end (code points), piece. Items up to the target, and items with a null
    text or target, give no rows; a null or negative overlap counts as 0, and one of the target or more as one
    character less than the target, the most that still gets on. A target under 1 counts as 1. Repeated rows are cut as often as they stand there. Other columns are not read.
    """
    keys = [F.col(c) for c in key_cols]
    rows = df.filter(F.col(target_col).isNotNull()).select(*keys, F.col(text_col).alias("__text"), F.greatest(F.col(target_col).cast("long"), F.lit(1)).alias("__target"), F.greatest(F.coalesce(F.col(overlap_col).cast("long"), F.lit(0)), F.lit(0)).alias("__overlap"))
    rows = rows.filter("char_length(__text) > __target")
    width = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _SUB_CHARS):
                    size += len(texts[stop])
                    stop += 1
                part = batch.slice(start, stop - start)
                cuts = cut_batch(texts[start:stop], part.column(width + 1).to_pylist(), part.column(width + 2).to_pylist())
                row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
                flat = [(k, a, b, texts[start + i][a:b]) for i, c in enumerate(cuts) for k, (a, b) in enumerate(c)]
                cols = [part.column(k).take(pa.array(row)) for k in range(width)]
                cols += [pa.array([f[k] for f in flat], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f"k{i}" for i in range(width)), "piece_no", "piece_start", "piece_end", "piece"])
                start = stop

    fields = ", ".join(f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(width))
    out = rows.mapInArrow(run, f"{fields}, piece_no int, piece_start long, piece_end long, piece string")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(key_cols)), "piece_no", "piece_start", "piece_end", "piece")


def with_limits(contexts: DataFrame, evidence: DataFrame, sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """(record_kind, record_id, body, target, overlap) of every context and evidence body that may exceed its source's limit.

    Bodies no longer than the smallest target of all profiles are dropped before any shuffle.
    """
    limits = profiles.select(F.col("content_type").alias("document_schema"), F.col("chunk_target_chars").alias("target"), F.col("chunk_overlap_chars").alias("overlap"))
    least = F.broadcast(profiles.agg(F.min("chunk_target_chars").alias("least")))
    source = sources.groupBy(F.col("id").alias("source_id")).agg(F.max_by("document_schema", "updated_at").alias("document_schema")).join(F.broadcast(limits), "document_schema").drop("document_schema")
    of_context = contexts.select("id", "source_id").dropDuplicates(["id"]).join(source, "source_id").select(F.col("id").alias("context_id"), "target", "overlap")
    long = lambda df: df.join(least, F.char_length("body") > F.col("least")).drop("least").dropDuplicates(["id"])
    bodies = long(contexts.select("id", "source_id", "body")).join(source, "source_id").select(F.lit("context").alias("record_kind"), F.col("id").alias("record_id"), "body", "target", "overlap")
    passages = long(evidence.select("id", "context_id", "body")).join(of_context, "context_id").select(F.lit("evidence").alias("record_kind"), F.col("id").alias("record_id"), "body", "target", "overlap")
    return bodies.unionByName(passages)
