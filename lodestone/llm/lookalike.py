"""Problem 5: one consistent form for text that looks the same.

A value is normalised in two steps. First compatibility normalisation, composition of accents, plain spaces and hyphens, radicals
to ideographs, and deletion of ignorable characters (joiners and selectors of emoji sequences stay). Then every word of letters and digits that
mixes Latin letters with letters of another alphabet becomes a lattice: each letter may stay or be read as its look-alike in any alphabet of the
word, Latin or not; the Viterbi path with the best character bigram score, in which a change of script inside a word costs dearly, is
taken. Bigrams are counted in the single-script words of the whole input and scored within their script, so that a rare alphabet is no worse
than a frequent one. Each value also gets the kinds of disguise it held.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Letters of other alphabets and the Latin letters they look like.
_TWINS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜавеѕіјкмнорстухүһԁԛԝѵ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγ" + "ԝգոսօհ" + "ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ",
        "ABESIJKMHOPCTYXYGQWabesijkmhopctyxyhdqwv" + "ABEZHIKMNOPTYXaiKvopuxy" + "wqnuoh" + "ABCEGHJKLMPRSTVWZ",
    )
)

_UNITS = "µμΩΩÅKåΩμ"

# CJK radicals without a compatibility mapping and their ideographs.
_RADICALS = dict(zip("⺁⺄⺌⺍⺐⺗⺝⺟⺠⺡⺢⺧⺫⺮⺯⺰⺲⺳⺶⺷⺹⺼⻁⻂⻃⻄⻅⻆⻇⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乙小小尢心月母民水水牛罒竹糸纟罒网羊羊耂月虎衤覀西见角角讠贝车辶辶辶阝钅長镸长门阝雨青韦页风飞食食饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"))
_RADICALS["⻳"] = "龟"
_HYPHENS = "‐‑‒⁃−﹣－˗"
_INVISIBLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")

#: What the JVM looks for before any Python runs: every character that a kind of disguise can consist of.
SUSPECT = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\xA0\\xAD\\u0132\\u0133\\u01C4-\\u01CC\\u01F1-\\u01F3\\u02D7\\u0300-\\u03A8\\u03AA-\\u03BB\\u03BD-\\u052F\\u0531-\\u058F\\u061C\\u1100-\\u11FF\\u13A0-\\u13FD\\u1680\\u17B4\\u17B5\\u180B-\\u180F\\u2000-\\u2012\\u2028-\\u202F\\u2043\\u205F-\\u206F\\u20D0-\\u20FF\\u2100-\\u214F\\u2212\\u24B6-\\u24E9\\u2E80-\\u2FDF\\u3000\\u3164\\uF900-\\uFAFF\\uFB00-\\uFB17\\uFE00-\\uFE0F\\uFE63\\uFEFF\\uFF0D\\uFF10-\\uFF19\\uFF21-\\uFF3A\\uFF41-\\uFF5A\\uFF66-\\uFFDC\\uFFF0-\\uFFF8\\x{1D173}-\\x{1D17A}\\x{1F12B}-\\x{1F149}\\x{1D400}-\\x{1D7FF}\\x{2F800}-\\x{2FA1F}\\x{E0000}-\\x{E0FFF}]"

_SUSPECT = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", SUSPECT))
_APART = re.compile("[A-Za-zÀ-ɏͰ-ԯ][\u0300-\u036f]")
_JAMO = re.compile("[ᄀ-ᇿ]")
# Words of letters and digits with a letter of an alphabet that has look-alikes of Latin letters. Only the start of a run of letters is tried, so that a long run costs one pass.
_FOREIGN = re.compile("[Ͱ-֏Ꭰ-\u13ff]")
_MIXED = re.compile("(?<![0-9A-Za-zÀ-ɏͰ-֏Ꭰ-\u13ff])[0-9A-Za-zÀ-ɏ]*+[Ͱ-֏Ꭰ-\u13ff][0-9A-Za-zÀ-ɏͰ-֏Ꭰ-\u13ff]*")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]{2,}|[Ͱ-Ͽ]{2,}|[Ѐ-ԯ]{2,}")


@lru_cache(100_000)
def _script(char: str) -> str:
    """latin, greek, cyrillic, ... of a letter; empty for others."""
    if char.isascii():
        return "latin" if char.isalpha() else ""
    name = unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""
    return name.lower()


def _emojiish(char: str) -> bool:
    return bool(char) and (ord(char) >= 0x1F000 or unicodedata.category(char) in ("So", "Sk") or char in "️#*0123456789")


@lru_cache(100_000)
def _kind(char: str) -> str:
    """The disguise that a single character is by itself, whatever stands around it; empty for none."""
    code = ord(char)
    if char in _HYPHENS:
        return "hyphen"
    if char != " " and unicodedata.category(char) in ("Zs", "Zl", "Zp") or char == "\x85":
        return "space"
    if 0x2E80 <= code < 0x2FE0:
        return "radical"
    how = unicodedata.decomposition(char)
    if how and char not in _UNITS:
        plain = unicodedata.normalize("NFKC", char)
        if 0xF900 <= code < 0xFB00 or 0x2F800 <= code < 0x2FA20:
            return "ideograph"
        if how.startswith(("<font>", "<wide>", "<narrow>")) and plain.isalnum() or how.startswith(("<circle>", "<square>")) and len(plain) == 1 and _script(plain) == "latin":
            return "style"  # raised and lowered letters carry a meaning, numbers in circles are list marks, squares of several letters are units
        if how.startswith("<compat>") and len(plain) > 1 and plain.isalpha() and _script(plain[0]) in ("latin", "armenian"):
            return "ligature"
    return ""


def _keeps(text: str, at: int) -> bool:
    """Whether the ignorable character at ``at`` has a function: emoji sequences, and joiners between letters of scripts that use them."""
    char, before, after = text[at], text[at - 1 : at], text[at + 1 : at + 2]
    if char == "‍":
        return _emojiish(before) and _emojiish(after) or _script(before or " ") == _script(after or " ") and _script(after or " ") in _JOINING
    if char == "‌":
        return _script(before or " ") == _script(after or " ") and _script(after or " ") in _JOINING
    if char in "︎️":
        return _emojiish(before) and before != "️"
    if 0xE0020 <= ord(char) <= 0xE007F:
        return bool(before) and (before == "\U0001f3f4" or 0xE0020 <= ord(before) <= 0xE007F)
    return 0xFE00 <= ord(char) <= 0xFE0D and "一" <= before <= "鿿"


_JOINING = frozenset("arabic devanagari bengali gurmukhi gujarati oriya tamil telugu kannada malayalam sinhala khmer mongolian syriac".split())


class BigramModel:
    """Log scores of letter bigrams from counts {(a, b): n}; ^ and $ stand for the ends of a word."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.total = Counter()
        for (a, _), n in counts.items():
            self.total[a] += n
        self.counts = counts
        self._within: Counter | None = None

    def score(self, a: str, b: str, least: float = -6.0) -> float:
        """Of b after a, among what follows a in the script of b; an unseen pair is as likely as its script is wide, and never below ``least``."""
        if self._within is None:
            self._within = Counter()
            for (x, y), n in self.counts.items():
                self._within[x, _script(y)] += n
        return max(least, math.log((self.counts.get((a, b), 0) + 0.125) / (self._within[a, _script(b)] + 5)))


def _reverse_twins() -> dict[str, dict[str, str]]:
    """For each other alphabet: Latin letter -> its look-alike there."""
    out: dict[str, dict[str, str]] = {}
    for other, latin in _TWINS.items():
        out.setdefault(_script(other), {}).setdefault(latin, other)
    return out


_BACK = _reverse_twins()


def _readings(char: str, scripts: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """A letter and its look-alikes: in Latin for a letter of another alphabet, in the other ``scripts`` for a Latin one."""
    twin = _TWINS.get(char)
    if twin:
        return (char, twin) if char not in _UNITS else (char,)
    return (char, *(_BACK[s][char] for s in sorted(scripts) if char in _BACK.get(s, ())))


def best_reading(word: str, model: BigramModel, around: Counter | None = None, switch: float = -12.0, change: float = -3.0) -> str:
    """The Viterbi path through the look-alike lattice of a word of letters and digits.

    switch: cost of two neighbouring letters of different scripts (half of it where digits lie between); change: cost of reading a letter as another one;
    around: letters of each script in the whole text: a word begins in a script that is rare in the rest of it at a cost.
    """
    rest = (around or Counter()) - Counter(map(_script, word))
    begin = lambda script: 3 * math.log((rest[script] + 1) / (rest.total() + 1))
    scripts = frozenset(_script(c) for c in set(word)) - {"latin", ""}
    scores, came = {("^", ""): 0.0}, []  # a state: the reading, and the script of the last letter
    for char in word:
        ahead, back = {}, {}
        for reading in _readings(char, scripts):
            own, step = _script(reading), 0.0 if reading == char else change
            for state, before in scores.items():
                last, script = state
                if own:
                    score = before + step + model.score(last.lower() if _script(last) else "^", reading.lower())
                    if not script:
                        score += begin(own)
                    elif script != own:
                        score += switch if _script(last) else switch / 2
                else:
                    score = before + (model.score(last.lower(), "$") if _script(last) else 0.0)
                new = (reading, own or script)
                if new not in ahead or score > ahead[new]:
                    ahead[new], back[new] = score, state
        scores = ahead
        came.append(back)
    at = max((s + (model.score(state[0].lower(), "$") if _script(state[0]) else 0.0), state) for state, s in scores.items())[1]
    path = []
    for back in reversed(came):
        path.append(at[0])
        at = back[at]
    return "".join(reversed(path))


def canonical(text: str, model: BigramModel) -> tuple[str, list[str]]:
    """The consistent form of a text, and the sorted kinds of disguise in it."""
    kinds: set[str] = set()
    around: Counter = Counter()

    def single(m: re.Match) -> str:
        char = m.group()
        if _INVISIBLE.match(char):
            if _keeps(text, m.start()):
                return char
            kinds.add("invisible")
            return ""
        kind = _kind(char)
        if kind:
            kinds.add(kind)
        return "-" if kind == "hyphen" else " " if kind == "space" else _RADICALS.get(char, char)

    def word(m: re.Match) -> str:
        run = m.group()
        scripts = {_script(c) for c in run if c not in _UNITS} - {""}
        if "latin" in scripts and len(scripts) > 1:
            if not around:
                for char, n in Counter(clean).items():
                    around[_script(char)] += n
                around.pop("", None)
            read = best_reading(run, model, around)
            if read != run:
                kinds.add("alphabet")
            return read
        return run

    clean = _SUSPECT.sub(single, text)
    if _APART.search(clean) or _JAMO.search(clean) and not unicodedata.is_normalized("NFC", clean):
        kinds.add("accent")
    clean = unicodedata.normalize("NFKC", clean)
    return _MIXED.sub(word, clean) if _FOREIGN.search(clean) else clean, sorted(kinds)


def bigram_counts(df: DataFrame, text_col: str) -> BigramModel:
    """Bigram counts of the words of one script over all rows. The alphabets bound the table: at most a million pairs of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(_LATIN_WORD.findall(text))
            for w, n in words.items():
                w = w.lower()
                for a, b in zip("^" + w, w + "$"):
                    pairs[a, b] += n
        keys = list(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64())], names=["a", "b", "n"])

    rows = df.select(F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")
    counted = rows.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return BigramModel({(r.a, r.b): r.n for r in counted.collect()})


def normalized(df: DataFrame, text_col: str, model: BigramModel, suspects_only: bool = False) -> DataFrame:
    """``df`` with canonical (string) and disguises (array<string>, empty for none) added.

    Null stays null (no disguises), an empty text stays empty. Every other column comes through, also one named canonical or
    disguises, which is replaced. suspects_only: only rows that hold a character from which a disguise can be made; the others are
    known to have none (they are still subject to compatibility normalisation when asked for).
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.drop("canonical", "disguises")
    if suspects_only:
        rows = rows.filter(F.col(text_col).rlike(SUSPECT))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else canonical(t, sent.value) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=[*batch.schema.names, "canonical", "disguises"])

    schema = StructType([*rows.schema.fields, StructField("canonical", StringType()), StructField("disguises", ArrayType(StringType()))])
    return rows.mapInArrow(run, schema)


def fields(contexts: DataFrame, specs: DataFrame) -> DataFrame:
    """(record_kind, record_id, field_name, value) of context titles and bodies and of spec keys."""
    stacked = contexts.select(F.lit("context").alias("record_kind"), F.col("id").alias("record_id"), F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("title", "body")))).alias("f"))
    return stacked.select("record_kind", "record_id", "f.field_name", "f.value").unionByName(
        specs.select(F.lit("spec").alias("record_kind"), F.col("id").cast("string").alias("record_id"), F.lit("key").alias("field_name"), F.col("key").alias("value"))
    )
