import pytest
from pyspark.sql import functions as F

from lodestone.llm import lookalike as la

WORDS = "aerolite tessaro norvane plus max pro air office officina forgecraft driftwood cobaltine workfield stratuso loaned account matte panel the price клавиша привод экран".split() * 5
MODEL = la.BigramModel({})
for w in WORDS:
    for a, b in zip("^" + w, w + "$"):
        MODEL.counts[a, b] = MODEL.counts.get((a, b), 0) + 1
        MODEL.total[a] += 1


@pytest.mark.parametrize(
    ("value", "plain", "kinds"),
    [
        ("Ａｅｒｏｌｉｔｅ １５", "Aerolite 15", ["style"]), ("𝙶𝙷𝚣", "GHz", ["style"]), ("Tessarо", "Tessaro", ["alphabet"]), ("Νｏｒｖａｎе", "Norvane", ["alphabet", "style"]), ("Рrо", "Pro", ["alphabet"]),
        ("so​ft", "soft", ["invisible"]), ("a­b", "ab", ["invisible"]), ("15 W", "15 W", ["space"]), ("a　b", "a b", ["space"]), ("fin‑stack", "fin-stack", ["hyphen"]), ("proﬁle", "profile", ["ligature"]),
        ("Solène", "Solène", ["accent"]), ("⼤⽂件⻓", "大文件长", ["radical"]), ("兀", "兀", ["ideograph"]),
    ],
)
def test_disguises(value, plain, kinds):
    assert la.canonical(value, MODEL) == (plain, kinds)


@pytest.mark.parametrize("value", ["Клавиша", "Ωμέγα", "5 μs 3 Ω 20°C", "Écrin Zéphyra", "👩🏽‍🔧 👍🏻", "❤️", "你好，世界。（是）！", "— … •", "k Ω"])
def test_no_case_by_itself(value):
    assert la.canonical(value, MODEL)[1] == []


@pytest.mark.parametrize("model", [MODEL, la.BigramModel({})])
@pytest.mark.parametrize(("value", "plain"), [("Мoсква", "Москва"), ("пpивет", "привет"), ("RTX4О60", "RTX4O60"), ("Tеssаro 14Рro", "Tessaro 14Pro"), ("Ωμέγa", "Ωμέγα")])
def test_the_lattice_leads_to_every_alphabet(value, plain, model):
    assert la.canonical(value, model) == (plain, ["alphabet"])


@pytest.mark.parametrize(("value", "plain"), [("Ⓛaptop", "Laptop"), ("🄰sus", "Asus"), ("ⓑody", "body")])
def test_letters_in_circles_and_squares_are_styles(value, plain):
    assert la.canonical(value, MODEL) == (plain, ["style"]) and la._SUSPECT.search(value)


@pytest.mark.parametrize("value", ["①②", "3 m²", "5㎞ 2㏄", "2ⁿ", "USBпорт", "экран 4K", "А4", "1ª"])
def test_marks_with_a_meaning_are_no_case(value):
    assert la.canonical(value, MODEL)[1] == []


def test_equal_looks_compare_as_equal():
    forms = ["Tessaro Plus 15", "Тessarо Рlus １５", "Tes​saro Plus 15"]
    assert len({la.canonical(f, MODEL)[0] for f in forms}) == 1
    for f in forms:
        once = la.canonical(f, MODEL)[0]
        assert la.canonical(once, MODEL) == (once, [])


def test_table_and_dirt(spark):
    df = spark.createDataFrame([(1, "Tessarо plus"), (2, None), (3, ""), (4, "Tessaro tessaro plus plus"), (1, "Tessarо plus"), (5, "x" * 100_000 + "​")], "id int, text string").withColumn("disguises", F.lit(7))
    model = la.bigram_counts(df, "text")
    got = sorted(((r.id, r.canonical and len(r.canonical), tuple(r.disguises)) for r in la.normalized(df, "text", model).collect()))
    assert got == [(1, 12, ("alphabet",)), (1, 12, ("alphabet",)), (2, None, ()), (3, "", ()), (4, 25, ()), (5, 100_000, ("invisible",))]
    assert {r.id for r in la.normalized(df, "text", model, suspects_only=True).collect()} == {1, 5}
    assert la.normalized(df.limit(0), "text", la.bigram_counts(df.limit(0), "text")).count() == 0


def test_long_words_take_one_pass():
    for word in ("x" * 300_000, "x" * 150_000 + "о" + "x" * 150_000, "xо" * 20_000):
        assert len(la.canonical(word, MODEL)[0]) == len(word)
