"""Problem 6: byte-level BPE encoding of a corpus by backtracking.

A text is split by the tokenizer's pattern. For each piece an Aho-Corasick automaton over all tokens gives the longest token
at every byte. The encoder takes the longest token, and keeps it only if it forms with the token before it a pair
that BPE merging would leave apart (the pair-compatibility test below, remembered in a table); else it tries the next
shorter token, and where none fits, steps back one token. The first sequence that reaches the end is exactly the result of the
merges, in time linear in the piece. A piece is first cut between characters that no token of the vocabulary spans: no merge can cross
there, so each segment is encoded alone, and short ones recur. Decoding looks tokens up in one byte string through an offset table.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the split pattern of this tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_MEMO = 400_000
_SHIFT = 20


def _byte_alphabet() -> dict[str, int]:
    """The file writes bytes as printable characters: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class BacktrackingBpe:
    """Encoder and decoder over a tokenizer file (JSON with model.vocab and model.merges)."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet = _byte_alphabet()
        special = {i for t, i in model["vocab"].items() if any(c not in alphabet for c in t)}
        special |= {i for t, i in model["vocab"].items() if t.startswith("<|") and t.endswith("|>")}
        self.token: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if i not in special}
        self.id_of = {t.decode("latin-1"): i for i, t in self.token.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        self.rank: dict[int, int] = {i: -1 for i in self.token}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merged[left << _SHIFT | right] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            self.automaton.add_word(text, (i, len(text) - 1))
        self.automaton.make_automaton()
        self.size = [len(self.token.get(i, b"")) for i in range(max(self.token) + 1)]
        self.split = regex.compile(PATTERN).findall
        self.spans: dict[str, bool] = {}
        self.segments: dict[str, tuple[int, ...]] = {}
        self.across: dict[str, list[tuple[str, str]]] = {}  # two neighbouring bytes -> the tokens that hold them, cut between them
        for text in self.id_of:
            for k in range(1, len(text)):
                if text[k] < "\x80" or text[k] >= "\xc0":  # a character begins here
                    self.across.setdefault(text[k - 1 : k + 1], []).append((text[:k], text[k:]))
        self.pair_ok: dict[int, bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = b"".join(self.token.get(i, b"") for i in range(len(self.size)))

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of token."""
        if token not in self.shorter:
            text = self.token[token].decode("latin-1")
            self.shorter[token] = next((self.id_of[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.id_of), None)
        return self.shorter[token]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: no merge across their border comes before the merges that built them.

        Undoes, again and again, the later of the two last merges; the parts that face the border are then what stood
        there at that time, and must not form a merge of a rank before it.
        """
        key = a << _SHIFT | b
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        x, y, limit, ok = a, b, 1 << 60, True
        while True:
            whole = self.merged.get(x << _SHIFT | y)
            if whole is not None and self.rank[whole] < limit:
                ok = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # x was made last; before, its right part stood at the border
                limit, x = rx, self.parts[x][1]
            else:  # merges of one rank go from left to right: the one across the border came before y's own
                limit, y = ry + 1, self.parts[y][0]
        if len(self.pair_ok) > 4 * _MEMO:
            self.pair_ok.clear()
        self.pair_ok[key] = ok
        return ok

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, given as its bytes in Latin-1."""
        whole = self.id_of.get(text)
        if whole is not None:
            return (whole,)
        n = len(text)
        longest: list[int | None] = [None] * n
        for end, (token, back) in self.automaton.iter(text):
            longest[end - back] = token
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which no way leads on
        size, known, compatible, shorter = self.size, self.pair_ok, self._compatible, self._shorter
        at, token, last = 0, longest[0], -1
        while at < n:
            while token is not None:
                if not dead[at + size[token]]:
                    if last < 0:
                        break
                    ok = known.get(last << _SHIFT | token)
                    if ok or ok is None and compatible(last, token):
                        break
                token = shorter(token)
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter(token)
                continue
            out.append(token)
            at += size[token]
            last = token
            token = longest[at] if at < n else None
        return tuple(out)

    def _spanned(self, pair: str) -> bool:
        """Whether some token may hold the border between two characters."""
        a, b = (c.encode("utf-8", "surrogatepass").decode("latin-1") for c in pair)
        fits = lambda x, y: x.endswith(y) or y.endswith(x)
        return any(fits(a, left) and (b.startswith(right) or right.startswith(b)) for left, right in self.across.get(a[-1] + b[0], ()))

    def _segmented(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of text."""
        out: list[int] = []
        spans, segments, start = self.spans, self.segments, 0
        for k in range(1, len(piece) + 1):
            if k < len(piece):
                pair = piece[k - 1 : k + 1]
                spanned = spans.get(pair)
                if spanned is None:
                    if len(spans) > 4 * _MEMO:
                        spans.clear()
                    spanned = spans[pair] = self._spanned(pair)
                if spanned:
                    continue
            segment = piece[start:k]
            ids = segments.get(segment)
            if ids is None:
                ids = self._piece(segment.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(segment) <= 32:
                    if len(segments) > _MEMO:
                        segments.clear()
                    segments[segment] = ids
            out.extend(ids)
            start = k
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; no ids for an empty text and for null."""
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text) if text else ():
            ids = memo.get(piece)
            if ids is None:
                ids = self._segmented(piece)
                if len(piece) <= 32:
                    if len(memo) > _MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        offsets, whole = self.offsets, self.bytes
        return b"".join(whole[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", "replace")


def _shipped(df: DataFrame, path: str):
    """Sends the tokenizer file to every executor; returns what finds it there."""
    df.sparkSession.sparkContext.addFile(path)
    name = Path(path).name
    return lambda: encoder(SparkFiles.get(name))


@lru_cache(4)
def encoder(path: str) -> BacktrackingBpe:
    """One encoder per worker and file."""
    return BacktrackingBpe(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id_col, ids) of every row of ``df``.

    Null and empty texts have the empty list of ids, never null. Strings of special tokens are ordinary text.
    Rows are neither dropped nor merged: a repeated row comes out repeated. Other columns are not read. The tokenizer file is read on the driver's side
    only and sent to the executors.
    """
    local = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = local().encode
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                flat, ends = array("i"), [0]
                for text in part.column(1).to_pylist():
                    flat.extend(encode(text))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """(id_col, text) of every row: the inverse of encode_corpus, but for null texts, which come back empty; null ids give null."""
    local = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = local().decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), "text")
