"""Batch text folding and character n-gram hashing with numpy, shared by the operators of this subpackage."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_TABLE = 0x20000
_SLOW = np.uint32(0xFFFFFFFF)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def fold_text(text: str) -> str:
    """Compatibility and case folding; only letters and digits stay."""
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if c.isalnum())


@lru_cache(1)
def _fold_table() -> np.ndarray:
    """Code point -> folded code point, 0 where it goes, _SLOW where the text needs fold_text."""
    out = np.zeros(_TABLE, dtype=np.uint32)
    for code in range(1, _TABLE):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.combining(char) or 0x1100 <= code < 0x1200 or unicodedata.category(char) in ("Mn", "Mc"):
            out[code] = _SLOW
            continue
        kept = fold_text(char)
        out[code] = 0 if not kept else ord(kept) if len(kept) == 1 else _SLOW
    return out


def fold_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts end to end, and the offsets of the texts in it (one more than texts)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(raw < _TABLE, _fold_table()[np.minimum(raw, _TABLE - 1)], _SLOW)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    slow = np.unique(doc[codes == _SLOW])
    keep = codes != 0
    if not len(slow):
        codes, doc = codes[keep], doc[keep]
        return codes, np.searchsorted(doc, np.arange(len(texts) + 1))
    is_slow = np.zeros(len(texts), dtype=bool)
    is_slow[slow] = True
    ends = np.cumsum(lengths)
    parts, sizes, at = [], np.zeros(len(texts), dtype=np.int64), 0
    keep &= ~np.repeat(is_slow, lengths)
    sizes += np.bincount(doc[keep], minlength=len(texts))
    for k in slow:  # the runs of plain texts between them stay vectorised
        start = ends[k] - lengths[k]
        parts.append(codes[at:start][keep[at:start]])
        own = np.frombuffer(fold_text(texts[k]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        parts.append(own)
        sizes[k] = len(own)
        at = ends[k]
    parts.append(codes[at:][keep[at:]])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def gram_hashes(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every run of ``n`` code points inside one text, and the number of its text."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    inside = doc[:count] == doc[n - 1 :]
    wide = codes.astype(np.uint64)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        h += wide[k : k + count] * _MULT[k % len(_MULT)] << np.uint64(k // len(_MULT))
    h, doc = h[inside], doc[:count][inside]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h, doc


def strings(codes: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The folded texts themselves."""
    whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
