import pickle

import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from lodestone.llm import pii

PARTS = pii.NameParts(frozenset("舟晞珩沅"), frozenset({"Tamsin", "Orlen"}), frozenset({"Holloren", "Wexlade"}))


def found(text):
    return [(k, text[s:e]) for s, e, k in pii.find_pii(text, PARTS)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("邮箱：a.b+c@mail.test，标题", [("email", "a.b+c@mail.test")]), ("x [at] y [dot] example 长期", [("email", "x [at] y [dot] example")]), ("h_s(at)post.h.invalid ", [("email", "h_s(at)post.h.invalid")]), ("root@debian:~# 提示符", []),
        ("电话 161-7599-9103 白天", [("phone", "161-7599-9103")]), ("+86 16386427327，", [("phone", "+86 16386427327")]), ("tel:００", []), ("打１６８３５８４１３８６找", [("phone", "１６８３５８４１３８６")]), ("打幺六三二三五四零零四四找", [("phone", "幺六三二三五四零零四四")]),
        ("（027）55503345加厚", [("phone", "（027）55503345")]), ("Call (702) 555-0136 before", [("phone", "(702) 555-0136")]), ("号码 161****9564 已脱敏", []), ("串号 SN916128029175896，", []), ("订单号 182171197031790101 已发货", []),
        ("身份证：11010519491231002X。", [("id_number", "11010519491231002X")]), ("身份证：110105194912310021。", []), ("SSN 962-81-5869 was", [("id_number", "962-81-5869")]), ("寄到云梧市白鹭滩街道流萤路748号。", [("address", "云梧市白鹭滩街道流萤路748号")]),
        ("岚港市南圃区渡口北路244弄8号C座14层1336室，", [("address", "岚港市南圃区渡口北路244弄8号C座14层1336室")]), ("Ship it to 191 Copperleaf Lane, Apt 34B, Galloway-on-Fen. Call", [("address", "191 Copperleaf Lane, Apt 34B, Galloway-on-Fen")]),
        ("联系人：侯舟晞，请先", [("name", "侯舟晞")]), ("Ask for Holloren, Tamsin at the desk", [("name", "Holloren, Tamsin")]), ("| Orlen K. Wexlade | OK |", [("name", "Orlen K. Wexlade")]), ("mail orlen.wexlade@x.test", [("email", "orlen.wexlade@x.test")]), ("", []),
    ],
)
def test_mentions(text, want):
    assert found(text) == want


@pytest.mark.parametrize("road", ["大道", "路", "街", "巷", "胡同", "道", "里"])
def test_an_address_of_every_road_word(road):
    assert found(f"寄到云梧市白鹭滩街道流萤{road}12号。") == [("address", f"云梧市白鹭滩街道流萤{road}12号")]


@settings(max_examples=200, deadline=None)
@given(hs.text(alphabet="0123456789", min_size=2, max_size=18))
def test_feistel_is_a_permutation_of_its_length(digits):
    assert len(pii.feistel_digits(digits, b"k", "t")) == len(digits)


@settings(max_examples=200, deadline=None)
@given(hs.sampled_from(["+86 1dddddddddd", "1dd-dddd-dddd", "1dd dddd dddd", "(0dd) dddddddd", "0ddd-ddddddd", "(dddd) dddddddd", "ddd-ddd-dddd", "+1 (ddd) ddd-dddd", "ddd-dd-dddd", "ddddddyyyyMMddddd", "dddddddddddddd"]), hs.randoms())
def test_numbers_keep_format_and_validity(form, rng):
    text = "".join(str(rng.randint(0, 9)) if c == "d" else c for c in form.replace("yyyyMM", f"19{rng.randint(10, 99)}0{rng.randint(1, 9)}"))
    mentions = [(text[s:e], k) for s, e, k in pii.find_pii(text, pii.NameParts())]
    for mention, kind in mentions:
        new = pii.pseudonym(mention, kind, b"k")[1:-1].split(" ", 1)[1]
        shape = lambda t: "".join("d" if c.isdigit() else c for c in t)
        assert shape(new) == shape(mention) and [(k, new[s:e]) for s, e, k in pii.find_pii(new, pii.NameParts())] == [(kind, new)]
        if kind == "phone" and mention.startswith(("+86", "(0", "0")):
            assert new[:3] == mention[:3]


def test_identity_numbers_of_15_digits_keep_a_date():
    for day in ("490101", "991231", "040229", "720630"):
        new = pii.pseudonym("110105" + day + "123", "id_number", b"k")[1:-1].split(" ")[1]
        assert len(new) == 15 and pii._valid_date("19" + new[6:12]) and new[0] != "0"
    assert len({pii._permuted_phone(f"138{n:08d}"[:11], b"k") for n in range(3000)}) == 3000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("联系人：阎伟", [("name", "阎伟")]), ("姓名 | 仝小雨 | 已缴费", [("name", "仝小雨")]), ("联系人：客服，电话", []), ("由于顶，掉了一格", []), ("Ask for Mary Jones at the desk", [("name", "Mary Jones")]), ("Dr. Alice Walker called", [("name", "Alice Walker")]), ("Ask for Customer Service at the desk", []),
        ("寄到西藏自治区拉萨市城关区北京中路8号。", [("address", "西藏自治区拉萨市城关区北京中路8号")]), ("云梧市白鹭滩街道流萤路748号" + "1号" * 60, [("address", "云梧市白鹭滩街道流萤路748号" + "1号" * 60)]),
    ],
)
def test_announced_names_need_no_known_parts_and_addresses_no_window(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.find_pii(text, pii.NameParts())] == want


def test_a_vocabulary_misses_none_of_its_words(spark):
    rows = [(k, f"Ask for {a}{b}ora {c}{d}well at") for k, (a, b, c, d) in enumerate((a, b, c, d) for a in "BCDF" for b in "aeio" for c in "GHKL" for d in "aeio")] * 2
    parts = pii.name_parts(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert all(f"{a}{b}ora" in parts.first for a in "BCDF" for b in "aeio") and all(f"{c}{d}well" in parts.last for c in "GHKL" for d in "aeio")
    again = pickle.loads(pickle.dumps(parts.first))
    assert again and "Bara" not in again and "Baora" in parts.first and "Baora" in again and len(pickle.dumps(parts.first)) < 100_000
    assert sum(f"X{k}" in parts.first for k in range(10_000)) == 0 and parts.first and not pii.name_parts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "text").first


def test_feistel_has_no_collisions():
    assert len({pii.feistel_digits(f"{n:04d}", b"k", "t") for n in range(10_000)}) == 10_000
    dates = {pii.permute_date(f"19{y:02d}{m:02d}15", b"k") for y in range(100) for m in range(1, 13)}
    assert len(dates) == 1200 and all(map(pii._valid_date, dates))


def test_pseudonyms_link_and_stay_valid():
    plain = lambda t, kind: "".join(c for c in pii.pseudonym(t, kind, b"k").split(" ", 1)[1] if c.isalnum())
    number = lambda t, kind: plain(t, kind).removeprefix("00").removeprefix("86")  # noqa: E731  # the country code stays as it was written
    a = number("11010519491231002X", "id_number")
    assert a == number("110105 19491231 002x", "id_number") and pii.valid_id(a) and a != "11010519491231002X"
    assert number("+86-161-7599-9103", "phone") == number("16175999103", "phone") == number("008616175999103", "phone") == number("１６１７５９９９１０３", "phone")
    assert plain("+86-161-7599-9103", "phone")[:2] == "86" and plain("008616175999103", "phone")[:4] == "0086"
    assert pii.pseudonym("A@B.test", "email", b"k") == pii.pseudonym("a@b.test", "email", b"k") != pii.pseudonym("a@b.test", "email", b"other")
    text = "联系人：侯舟晞，电话 161-7599-9103 白天能接"
    out = pii.redact(text, PARTS, b"k")
    assert out.startswith("联系人：[NAME ") and out.endswith(" 白天能接") and "[PHONE 1" in out and "7599" not in out


def test_learned_names_and_dirt(spark):
    rows = [(k, f"联系人：侯{c}舟，请先登记。我叫侯{c}晞，想问") for k, c in enumerate("晞珩沅舟")] + [(10, "Ask for Tamsin Holloren at the desk. Signed by Orlen Wexlade on"), (11, "My name is Tamsin Holloren and x. Owner: Orlen Wexlade; y"), (12, "| 侯珩舟 | OK | Wexlade, Orlen"), (20, None), (21, "")]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string").withColumn("pii_type", F.lit(0)).withColumn("id", F.lit(0))
    got = [tuple(r) for r in pii.pii_mentions(df, b"k").drop("placeholder").collect()]
    assert len(got) == len(set(got)) and (12, "name", "侯珩舟") in got and (12, "name", "Wexlade, Orlen") in got and (0, "name", "侯晞舟") in got
    clean = {r.doc_id: r.text for r in pii.redacted(df, b"k").collect()}
    assert clean[20] is None and clean[21] == "" and "侯" not in clean[0]
    assert pii.pii_mentions(df.limit(0), b"k").count() == 0


def test_very_many_mentions_in_one_text():
    text = "a.b@example.org " * 60_000
    found = pii.find_pii(text, pii.NameParts(frozenset(), frozenset(), frozenset()))
    assert len(found) == 60_000 and found == sorted(found) and {k for *_, k in found} == {"email"}
