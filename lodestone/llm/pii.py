"""Problem 8: personal information in free text, replaced by typed placeholders with format-preserving pseudonyms.

E-mail addresses, phone numbers, identity numbers and street addresses are found by form and checked (no longer digit
run around them, valid dates and check digits). Names have no form of their own: they are taken where the words around them announce a
person, whatever they are made of; a first pass over the corpus counts the parts of all of these, and the second pass also finds names made of
such parts anywhere. Numbers and dates are then permuted within their format by a keyed Feistel network (walking on until the
result is as valid as the number was; country and area codes stay), names, e-mail addresses and addresses get a keyed tag: equal values
stay equal across documents.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.tables import materialize

# Common Chinese family names, of two characters and of one.
_COMPOUND = "欧阳 司徒 上官 慕容 诸葛 司马 皇甫 东方 尉迟 公孙 令狐 宇文 长孙 夏侯 轩辕 端木 独孤 南宫".split()
_SINGLE = "王李张刘陈杨黄赵周吴徐孙马胡朱郭何罗高林郑梁谢唐许冯宋韩邓彭曹曾田萧潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫雷龙史陶贺毛段郝顾龚邵万覃武钱戴严欧莫孔向常汤康易乔赖文施洪辛柯阮温俞裴骆祁柳戚郁盛闻葛宁安"

_HAN = "一-鿿"
_ZH_NAME = rf"(?:{'|'.join(_COMPOUND)}|[{_SINGLE}])[{_HAN}]{{1,2}}"
_EN_WORD = r"[A-Z][a-z]+(?:[-'’][A-Z][a-z]+)?"
_EN_NAME = rf"{_EN_WORD}(?: [A-Z]\.)? {_EN_WORD}|{_EN_WORD}, {_EN_WORD}"

# Words that announce a person: what stands before and after the name.
_ZH_CUES = (
    (r"联系人[：: ]?", r"(?=[，,。；;\s]|$)"), (r"收件人[：: ]?", r"(?=已|[，,。；;\s]|$)"), (r"经手人[（(：:]", r"(?=[）)，,。])"), (r"机主[：: ]?", r"(?=下午|上午|[，,。；;\s]|$)"),
    (r"姓名[：: ]+", r"(?=[ |，,。；;]|$)"), (r"我叫", r"(?=[，,。；;\s]|$)"), (r"(?:工单)?由", r"(?=签收|经手|[，,。；;])"), (r"这台是", r"(?=托我)"), (r'"(?:owner|name|user)": ?"', r'(?=")'), (r"(?:user|owner|name)=", r"(?=[;,\s]|$)"),
)
_EN_CUES = (
    (r"Ask for ", r"(?= at\b|[.,;])"), (r"belongs to ", r"(?=[.,;\s]|$)"), (r"Signed by ", r"(?= on\b|[.,;])"), (r"[Mm]y name is ", r"(?= and\b|[.,;])"), (r'"(?:owner|name|user)": ?"', r'(?=")'), (r"(?:user|owner|name)=", r"(?=[;\s]|$)"), (r"Owner: ", r"(?=[;.,\s]|$)"), (r"—— ", r"(?=\s|$)"),
)
# Words that stand where a name may be announced, but name a role or a field.
_ROLES = frozenset("客服 本人 用户 同学 同事 前台 店员 快递 买家 卖家 厂家 售后 保密 未知 匿名 客户 管理员 电话 手机 邮箱 地址 姓名 无 同上".split())
_OFFICES = frozenset("Service Support Team Desk Office Center Centre Department Sales Customer Help Staff Shop Store".split())
_ZH_FIELD = re.compile(rf"(?:联系人|收件人|寄件人|经手人|签收人|负责人|机主|姓名)(?: ?[：:|] ?|[（(])([{_HAN}]{{2,3}})(?=[，,。；;、）)|\s]|$)")
_EN_TITLE = re.compile(rf"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? ({_EN_NAME})(?![A-Za-z@])")
_ZH_CUED = re.compile("|".join(f"(?:{a})({_ZH_NAME}){b}" for a, b in _ZH_CUES))
_EN_CUED = re.compile("|".join(f"(?:{a})({_EN_NAME}){b}" for a, b in _EN_CUES))

_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*(?:\s?(?:@|＠|\(at\)|\[at\]|（at）)\s?)[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+", re.I
)
_D = "0-9０-９"
# Patterns begin with the characters they can begin with, and look back after them: the search then skips to these.
_ID = re.compile(rf"([1-9１-９](?<![{_D}A-Za-z\-].)[{_D}]{{5}})([ \-]?)([{_D}]{{8}})\2([{_D}]{{3}}[{_D}XxＸｘ])(?![{_D}])")
_ID15 = re.compile(rf"[1-9](?<![{_D}A-Za-z\-].)[0-9]{{5}}([0-9]{{6}})[0-9]{{3}}(?![{_D}])")
_SSN = re.compile(r"[0-9](?<![0-9A-Za-z\-.].)[0-9]{2}[- ][0-9]{2}[- ][0-9]{4}(?![0-9\-])")
_PHONE_START = re.compile(rf"[+＋（(0-9０-９](?<![{_D}A-Za-z\-.+*].)")
_SPOKEN = re.compile(r"[幺一](?<![幺零一二三四五六七八九].)[三四五六七八九][幺零一二三四五六七八九]{9}(?![幺零一二三四五六七八九])")
_PHONE = re.compile(
    rf"(?<![{_D}A-Za-z\-.+*])(?:"
    rf"(?:(?:[+＋]|00)?86[ \-]?)?[1１][3-9３-９][{_D}](?:([ \-])[{_D}]{{4}}\1[{_D}]{{4}}|[{_D}]{{8}})"
    rf"|[（(]0[0-9]{{2,3}}[)）][ \-]?[0-9]{{7,8}}|0[0-9]{{2,3}}[ \-](?:[0-9]{{7,8}}|[0-9]{{3,4}}[ \-][0-9]{{4}})"
    rf"|(?:\+?1[ \-.]?)?(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[\-. ])[0-9]{{3}}[\-. ][0-9]{{4}}|\+1[2-9][0-9]{{9}}"
    rf")(?![{_D}*]|[\-.][{_D}])"
)
_ZH_ROADS = "大道 路 街 巷 胡同 道 里".split()
_REGIONS = "内蒙古 广西壮族 西藏 宁夏回族 新疆维吾尔".split()
_ZH_ADDRESS = re.compile(
    rf"(?:(?:{'|'.join(_REGIONS)})自治区(?:[{_HAN}]{{2,5}}?(?:市|州|盟|地区))?|(?:[{_HAN}]{{2,3}}省)?[{_HAN}]{{2}}(?:市|州|县|盟))(?:[{_HAN}]{{1,3}}?(?:街道|新区|区|县|镇|乡)){{0,2}}[{_HAN}]{{1,6}}?(?:{'|'.join(_ZH_ROADS)}) ?[0-9０-９]{{1,5}}(?:-[0-9]{{1,4}})? ?(?:弄|号|號)"
    rf"(?: ?(?:[0-9０-９]{{1,5}}(?:-[0-9]{{1,4}})?|[A-Za-z]) ?(?:号楼|号|幢|栋|座|单元|层|楼|室|户))*(?:(?<=单元) ?[0-9]{{1,5}}室?|(?<=层) ?[0-9]{{1,5}}室?)?"
)
_BEFORE_ROAD = 8 + 7 + 10 + 6 + 2  # the most characters that the pattern has before its road number: region, city, two districts, road and its word
_EN_ADDRESS = re.compile(
    rf"[0-9](?<![0-9A-Za-z\-.].)[0-9]{{0,4}} (?:{_EN_WORD} ){{1,3}}(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Court|Ct\.?|Drive|Dr\.?|Way|Place|Square|Terrace|Boulevard|Blvd\.?),? "
    rf"(?:(?:Apt|Unit|Floor|Suite|Flat|Room)\.? ?#?[0-9]{{1,5}}[A-Za-z]?, )?[A-Z][a-z]+(?:(?:-| )(?:on|upon|under|in|le|by)(?:-| )[A-Z][a-z]+|(?:-| )[A-Z][a-z]+)*"
)
_AT = re.compile(r"@|＠|[(\[（]at", re.I)
_ZH_ROAD = re.compile(rf"[{''.join(sorted({w[-1] for w in _ZH_ROADS}))}] ?[0-9０-９]")

_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)  # fixed values: the check digit of an 18-digit identity number
_CHECK = "10X98765432"


@dataclass(frozen=True)
class NameParts:
    """What names are made of: characters of Chinese given names, English given and family names."""

    given: frozenset[str] = frozenset()
    first: Container[str] = frozenset()
    last: Container[str] = frozenset()


_SLOT_BITS = 26


def _slots(word: str) -> tuple[int, int]:
    h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h & (1 << _SLOT_BITS) - 1, h >> 32 & (1 << _SLOT_BITS) - 1


class Vocabulary:
    """A set of words in a bitmap of 8 MB, however many words: a few hundred thousand words take one strange word in 10,000 for one of theirs, and none of theirs is ever missed."""

    def __init__(self, chunks: dict[int, bytes]):
        self.bits = np.zeros(1 << _SLOT_BITS - 3, np.uint8)
        for k, blob in chunks.items():
            self.bits[k * len(blob) : (k + 1) * len(blob)] = np.frombuffer(blob, np.uint8)
        self.words = bool(chunks)
        self.memo: dict[str, bool] = {}

    def __getstate__(self) -> tuple[bytes, bool]:  # mostly zeros: it travels packed
        return zlib.compress(self.bits.tobytes(), 1), self.words

    def __setstate__(self, state: tuple[bytes, bool]) -> None:
        self.bits, self.words, self.memo = np.frombuffer(zlib.decompress(state[0]), np.uint8), state[1], {}

    def __bool__(self) -> bool:
        return self.words

    def __contains__(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 200_000:  # a cache, refilled
                self.memo.clear()
            known = self.memo[word] = all(self.bits[s >> 3] >> (s & 7) & 1 for s in _slots(word))
        return known


def _split_zh(name: str) -> tuple[str, str]:
    n = 2 if name[:2] in _COMPOUND else 1
    return name[:n], name[n:]


def _split_en(name: str) -> tuple[str, str]:
    if ", " in name:
        last, first = name.split(", ")
    else:
        first, last = name.split(" ")[0], name.split(" ")[-1]
    return first, last


def _announced(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, kind, sure) of every name that words around it announce; sure: its end is plain, whatever the name is made of."""
    for pattern, kind in ((_ZH_CUED, "zh"), (_EN_CUED, "en")):
        for m in pattern.finditer(text):
            start, end = m.span(next(k for k, g in enumerate(m.groups(), 1) if g))
            if kind == "zh":
                plain = text[start - 1 : start] != "由"  # "by", but also the beginning of "because"
                yield start, end, kind, plain and text[start:end] not in _ROLES and not "一" <= text[end : end + 1] <= "鿿"
            else:
                yield start, end, kind, _OFFICES.isdisjoint(text[start:end].split(" "))
    for m in _ZH_FIELD.finditer(text):
        yield *m.span(1), "any", m.group(1) not in _ROLES
    for m in _EN_TITLE.finditer(text):
        yield *m.span(1), "en", _OFFICES.isdisjoint(m.group(1).split(" "))


def _cued(text: str) -> Iterator[tuple[str, str]]:
    """(part, kind) of every announced name."""
    for start, end, kind, _ in _announced(text):
        if kind == "zh":
            yield from ((c, "given") for c in _split_zh(text[start:end])[1])
        elif kind == "en":
            a, b = _split_en(text[start:end])
            yield from ((a, "first"), (b, "last"))


def name_parts(df: DataFrame, text_col: str, least: int = 2) -> NameParts:
    """Counts the parts of announced names over all rows; a part counts from ``least`` rows on.

    What comes to the driver is bounded: single ideographs, and two bitmaps of 8 MB, in which all words are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for t in batch.column(0).to_pylist() for p in set(_cued(t))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], names=["part", "kind"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, s) for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in _slots(p)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([s >> 19 for _, s in pairs], pa.int32()), pa.array([s & 0x7FFFF for _, s in pairs], pa.int32())], names=["kind", "chunk", "slot"])

    def bitmap(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 19, bool)
        bits[group.column("slot").to_numpy()] = True
        return pa.table({"kind": group.column("kind").slice(0, 1), "chunk": group.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = df.select(F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''").mapInArrow(run, "part string, kind string")
    counted = materialize(rows.groupBy("part", "kind").count().filter(F.col("count") >= least), "names")
    given = frozenset(r["part"] for r in counted.filter("kind = 'given'").toLocalIterator())
    words = counted.filter("kind <> 'given'").select("part", "kind").mapInArrow(slots, "kind string, chunk int, slot int").distinct()
    chunks: dict[str, dict[int, bytes]] = {"first": {}, "last": {}}
    for r in words.groupBy("kind", "chunk").applyInArrow(bitmap, "kind string, chunk int, bits binary").toLocalIterator():
        chunks[r["kind"]][r["chunk"]] = bytes(r["bits"])
    return NameParts(given, Vocabulary(chunks["first"]), Vocabulary(chunks["last"]))


_EN_START = re.compile(r"[A-Z](?<![A-Za-z@.+\-_].)[a-z]+(?:[-'’][A-Z][a-z]+)?")
_EN_HERE = re.compile(rf"(?:{_EN_NAME})(?![A-Za-z@_\-])")


_ANNOUNCING = "人主名叫由是系致者"


@lru_cache(4)
def _zh_patterns(given: frozenset[str]) -> tuple[re.Pattern, ...]:
    """Names of a family name of one and of two characters, at the beginning of a run of ideographs or after a character that announces one."""
    if not given:
        return ()
    end = rf"[{''.join(sorted(given))}]{{1,2}}(?![{_HAN}])"
    one = rf"[{_SINGLE}](?:(?<![{_HAN}].)|(?<=[{_ANNOUNCING}].)){end}"
    two = rf"(?:{'|'.join(_COMPOUND)})(?:(?<![{_HAN}]..)|(?<=[{_ANNOUNCING}]..)){end}"
    return re.compile(two, re.S), re.compile(one, re.S)


def _known_names(text: str, parts: NameParts) -> Iterator[tuple[int, int]]:
    """Names made of known parts, wherever they stand."""
    for pattern in _zh_patterns(parts.given):
        for m in pattern.finditer(text):
            yield m.span()
    if parts.first and parts.last:
        end = 0
        for word in _EN_START.finditer(text):
            if word.start() >= end and (word.group() in parts.first or word.group() in parts.last) and (m := _EN_HERE.match(text, word.start())):
                first, last = _split_en(m.group())
                if first in parts.first and last in parts.last:
                    yield m.span()
                    end = m.end()


def _digits(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def valid_id(number: str) -> bool:
    """Whether 18 digits have a possible date of birth and the right check digit."""
    n = re.sub(r"[ \-]", "", _digits(number)).upper()
    try:
        datetime.date(int(n[6:10]), int(n[10:12]), int(n[12:14]))
    except ValueError:
        return False
    return 1900 <= int(n[6:10]) <= 2035 and _CHECK[sum(int(d) * w for d, w in zip(n, _WEIGHTS)) % 11] == n[17]


def find_pii(text: str, parts: NameParts) -> list[tuple[int, int, str]]:
    """(start, end, type) of every mention, in order, without overlaps; forms come before names."""
    found: list[tuple[int, int, str]] = []  # kept in order: a text may hold very many mentions

    def add(start: int, end: int, kind: str) -> None:
        k = bisect_left(found, (start,))
        if start < end and (not k or found[k - 1][1] <= start) and (k == len(found) or end <= found[k][0]):
            found.insert(k, (start, end, kind))

    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    for m in _ID.finditer(text):
        if valid_id(m.group()):
            add(m.start(), m.end(), "id_number")
    for m in _ID15.finditer(text):
        if _valid_date("19" + m.group(1)):
            add(m.start(), m.end(), "id_number")
    for m in _SSN.finditer(text):
        add(m.start(), m.end(), "id_number")
    at = 0
    for anchor in _ZH_ROAD.finditer(text):
        if anchor.start() < at:
            continue
        for start in range(max(at, anchor.start() - _BEFORE_ROAD), anchor.start()):
            if (m := _ZH_ADDRESS.match(text, start)) and m.end() >= anchor.end():
                add(m.start(), m.end(), "address")
                at = m.end()
                break
    for m in _EN_ADDRESS.finditer(text):
        add(m.start(), m.end(), "address")
    at = 0
    for start in _PHONE_START.finditer(text):
        if start.start() >= at and (m := _PHONE.match(text, start.start())):
            add(m.start(), m.end(), "phone")
            at = m.end()
    for m in _SPOKEN.finditer(text):
        add(m.start(), m.end(), "phone")
    for start, end, kind, sure in _announced(text):
        if sure or kind == "zh" and parts.given.issuperset(_split_zh(text[start:end])[1]):
            add(start, end, "name")
    for start, end in _known_names(text, parts):
        add(start, end, "name")
    return found


def _round(key: bytes, kind: str, k: int, value: int, tweak: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}|{k}|{value}|{tweak}".encode(), key=key, digest_size=8).digest(), "big")


def feistel_digits(digits: str, key: bytes, kind: str, rounds: int = 8) -> str:
    """A keyed permutation of the digit strings of one length."""
    if len(digits) < 2:
        return str((int(digits) + _round(key, kind, 0, 0, 1)) % 10) if digits else digits
    half = len(digits) // 2
    sizes = (10**half, 10 ** (len(digits) - half))
    a, b = int(digits[:half]), int(digits[half:])
    for k in range(rounds):
        if k % 2 == 0:
            a = (a + _round(key, kind, k, b, len(digits))) % sizes[0]
        else:
            b = (b + _round(key, kind, k, a, len(digits))) % sizes[1]
    return f"{a:0{half}d}{b:0{len(digits) - half}d}"


_FIRST_DAY = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2036, 1, 1) - _FIRST_DAY).days


def permute_date(digits: str, key: bytes) -> str:
    """A keyed permutation of the dates of 1900 to 2035 (yyyymmdd): of their day numbers, walking on while out of range."""
    number = f"{(datetime.date(int(digits[:4]), int(digits[4:6]), int(digits[6:8])) - _FIRST_DAY).days:05d}"
    number = feistel_digits(number, key, "date")
    while int(number) >= _DAYS:
        number = feistel_digits(number, key, "date")
    return (_FIRST_DAY + datetime.timedelta(int(number))).strftime("%Y%m%d")


def _valid_date(d: str) -> bool:
    try:
        return 1900 <= int(d[:4]) <= 2035 and bool(datetime.date(int(d[:4]), int(d[4:6]), int(d[6:8])))
    except ValueError:
        return False


def _walk(digits: str, key: bytes, kind: str, valid) -> str:
    """The next valid digits on the permutation's cycle: a permutation of the valid ones."""
    new = feistel_digits(digits, key, kind)
    while not valid(new) and new != digits:
        new = feistel_digits(new, key, kind)
    return new


def _permuted_id(n: str, key: bytes) -> str:
    """An identity number of 18, 15 or 9 digits as another valid one."""
    if len(n) == 9:
        issued = lambda d: d[0] != "9" and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"
        return _walk(n, key, "ssn", lambda d: issued(d) == issued(n))
    area = _walk(n[:6], key, "area", lambda d: d[0] != "0")
    if len(n) == 15:
        date = permute_date("19" + n[6:12], key)
        while date[:2] != "19":
            date = permute_date(date, key)
        return area + date[2:] + feistel_digits(n[12:], key, "order")
    body = area + permute_date(n[6:14], key) + feistel_digits(n[14:17], key, "order")
    return body + _CHECK[sum(int(d) * w for d, w in zip(body, _WEIGHTS)) % 11]


def _permuted_phone(plain: str, key: bytes) -> str:
    """A phone number in its own format: country code, area code of a landline and the 1 of a mobile number stay."""
    kept = re.match(r"(?:(?:\+|00)?86[ \-]?(?=1[3-9])|\+?1[ \-.]?(?=[(2-9]))?(?:[(]?0\d{2,3}[)\- ]|1(?=[3-9]\d(?:\D?\d){8}$))?", plain).group()
    rest = plain[len(kept) :]

    def shaped(digits: str) -> str:
        left = iter(digits)
        return kept + "".join(next(left) if c.isdigit() else c for c in rest)

    return shaped(_walk(re.sub(r"\D", "", rest), key, "phone", lambda d: d[0] != "0" and _PHONE.fullmatch(shaped(d)) is not None))


def pseudonym(mention: str, kind: str, key: bytes) -> str:
    """Placeholder of a mention: [TYPE value], the value in the mention's own format for numbers, a tag of 64 bits for the others."""
    plain = _digits(mention).translate(str.maketrans("幺零一二三四五六七八九", "10123456789"))
    if kind == "id_number":
        left = iter(_permuted_id(re.sub(r"[ \-]", "", plain).upper(), key))
        value = "".join(next(left) if c.isalnum() else c for c in plain)
    elif kind == "phone":
        value = _permuted_phone(plain, key)
    else:
        folded = re.sub(r"\s", "", plain).casefold()
        value = hashlib.blake2b(f"{kind}|{folded}".encode("utf-8", "surrogatepass"), key=key, digest_size=8).hexdigest()
    return f"[{kind.upper()} {value}]"


def redact(text: str, parts: NameParts, key: bytes) -> str:
    """The text with a placeholder for every mention."""
    out, at = [], 0
    for start, end, kind in find_pii(text, parts):
        out += [text[at:start], pseudonym(text[start:end], kind, key)]
        at = end
    return "".join(out) + text[at:]


def pii_mentions(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", parts: NameParts | None = None) -> DataFrame:
    """Distinct (id_col, pii_type, pii_text, placeholder) of all mentions. Null and empty texts have none; other columns are not read."""
    sent = df.sparkSession.sparkContext.broadcast(parts or name_parts(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kind, text, instead = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for s, e, what in find_pii(t, sent.value):
                    row.append(k)
                    kind.append(what)
                    text.append(t[s:e])
                    instead.append(pseudonym(t[s:e], what, key))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(instead, pa.string())], names=["id", "pii_type", "pii_text", "placeholder"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pii_type string, pii_text string, placeholder string")
    return out.distinct().select(F.col("id").alias(id_col), "pii_type", "pii_text", "placeholder")


def redacted(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", parts: NameParts | None = None) -> DataFrame:
    """(id_col, text) with placeholders, one row per row of ``df``; null and empty texts stay as they are."""
    sent = df.sparkSession.sparkContext.broadcast(parts or name_parts(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, sent.value, key) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), "text")
