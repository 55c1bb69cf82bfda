import pytest
from pyspark.sql import functions as F

from lodestone.functions import conditions as cond, text as tx
from lodestone.operators import reconcile as rc, retrieval as rt, structure as st
from lodestone.sources import tables
from lodestone.sources.manifest import is_folder_name
from lodestone.streaming import upsert


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_titles_names_and_identities(spark):
    assert one(spark, tx.clean_title, "【甲】【乙】 教程 | 装机 ⭐⭐", "正文【括号】与 ⭐ 保留", "  普通  ", "甲｜ 乙", "x" * 21 + "|y", "", None) == ["装机", "正文【括号】与 ⭐ 保留", "普通", "乙", "x" * 21 + "|y", "", None]
    assert one(spark, tx.gpu_name, "rtx5070ti", " RTX 5070 Ti", "gtx 1650", "Arc  A770M", "RTX 4060 Laptop", None) == ["RTX 5070Ti", "RTX 5070Ti", "GTX 1650", "Arc A770M", "RTX 4060 Laptop", None]
    links = ["https://mp.a.example/s?__biz=Mz%3D%3D&amp;mid=12&amp;idx=1&amp;sn=x", "http://mp.a.example/s/ab_C-1?x=1", "https://mp.a.example/s?mid=1", "https://other.example/s/abc", "ftp://mp.a.example/s/abc", "not a link", None]
    assert one(spark, lambda c: tx.article_identity(c, F.lit("k7"), r"^mp\."), *links) == ["mp:Mz==:12:1", "mp:s:ab_C-1", None, None, None, None, "capture:k7"]


def test_pieces_synonyms_and_placeholders(spark):
    assert one(spark, tx.search_terms, "ThinkBook14+ 续航", "air 3.5", None)[0] == ["thinkbook14+", "thinkbook", "14+", "续航"]
    groups = tx.parse_synonyms("fan, noise # sounds\n\n续航，电池\n")
    assert groups == (("fan", "noise"), ("续航", "电池"))
    assert one(spark, lambda c: tx.expand_synonyms(c, groups), "a Fan", "none", None) == ["a Fan noise", "none", ""]
    for wrong in ("alone", "a, bc"):
        with pytest.raises(ValueError):
            tx.parse_synonyms(wrong)
    assert one(spark, tx.image_placeholders, "x ![](u) ![cat](v)") == ["x [image without description] [image: cat]"]
    assert one(spark, tx.plain_links, "see [this](u) and ![pic](v) <font color=red>red</font>") == ["see this and ![pic](v) red"]


def test_row_groups_leaves_bold_lines_and_callouts(spark):
    text = "# T\n## A\n| h |\n|---|\n| one |\n| two |\n| three |\n\n**Bold title**\nnot **bold** all\n## B\n### C\n> [!warning]\n> hot\n> plate\n\n> plain\n| alone |"
    lines = st.text_lines(spark.createDataFrame([("a", text), ("b", None)], "id string, t string"), "id", "t")
    groups = sorted((r.first_line, r.group_no, r.header, r.body) for r in st.row_groups(lines, "id", 10).collect())
    assert groups == [(3, 0, "| h |\n|---|", "| one |\n| two |"), (3, 1, "| h |\n|---|", "| three |")]
    assert sorted((r.line_no, r.level, r.title) for r in st.leaf_sections(lines, "id").collect()) == [(2, 2, "A"), (12, 3, "C")]
    assert [(r.line_no, r.title) for r in st.bold_headings(lines, "id").collect()] == [(9, "Bold title")]
    assert [(r.first_line, r.kind, r.lines, r.text) for r in st.callouts(lines, "id").collect()] == [(13, "WARNING", 3, "hot\nplate")]


def test_links_gates_and_grades(spark):
    specs = spark.createDataFrame([(1, "A 1"), (2, "B2"), (3, "C3"), (4, None)], "id int, key string")
    reviews = spark.createDataFrame([("x", "A1"), ("y", "B2"), ("z", "B 2"), ("y", "B2")], "id string, title string")
    assert sorted((r.id, r.reviews, r.context_id, r.status) for r in rc.link_by_title(specs, "id", "key", reviews, "id", "title").collect()) == [(1, 1, "x", "linked"), (2, 2, None, "failed"), (3, 0, None, "unlinked"), (4, 0, None, "unlinked")]
    gate = rc.all_or_nothing(spark.createDataFrame([("f", 1), ("f", -1), ("g", 2)], "file string, n int"), "file", F.col("n") < 0)
    assert sorted(tuple(r) for r in gate.collect()) == [("f", 2, 1, 0), ("g", 1, 0, 1)]
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, False)], "i int, a boolean, b boolean")
    assert [tuple(r) for r in df.orderBy("i").select(*cond.grade([F.col("a"), F.col("b")])).collect()] == [(2, 2), (1, 1), (0, 0)]
    stored = spark.createDataFrame([("s1", "h1"), ("s2", "h2")], "id string, hash string")
    contexts = spark.createDataFrame([("s1",)], "source_id string")
    assert [r.id for r in rc.unchanged(stored, stored, contexts, ["hash"]).collect()] == ["s1"]


def test_matches_keep_order_scores_and_routes(spark):
    route = lambda *r: spark.createDataFrame(list(r), "query_id string, id string, rank int, score double")
    fused = rt.fuse({"keyword": route(("q", "a", 1, 9.0), ("q", "b", 2, 8.0), ("q", "b", 2, 8.5)), "vector": route(("q", "c", 1, 0.5))}, "id", 20)
    assert {r.id: r.route_scores for r in fused.collect()} == {"a": {"keyword": 9.0}, "b": {"keyword": 8.5}, "c": {"vector": 0.5}}
    children = spark.createDataFrame([("a", "p", "k2"), ("b", "p", "k1"), ("c", "r", "k0")], "id string, parent string, stable_key string")
    got = rt.group_matches(fused, children, "id", "parent", 5).orderBy("rank").collect()
    assert [(r.parent, r.kind, [m.id for m in r.matches]) for r in got] == [("r", "vector", ["c"]), ("p", "keyword", ["a", "b"])]


def test_bm25_blocks_and_cuts_agree(spark):
    docs = rt.with_terms(spark.createDataFrame([(k, f"fan noise {'fan ' * (k % 5)} word{k % 7}") for k in range(60)], "id int, t string").repartition(5), "id", F.col("t"))
    queries = spark.createDataFrame([("a", ["fan", "word3"]), ("b", ["noise"]), ("c", ["nothing"]), ("d", ["word1", "word2"])], "query_id string, terms array<string>")
    rows = lambda df: sorted((r.query_id, r.id, r.score) for r in df.collect())
    whole = rows(rt.bm25(docs, queries, "id", digits=6))
    assert rows(rt.bm25(docs, queries, "id", digits=6, block=1)) == whole and {q for q, *_ in whole} == {"a", "b", "d"}
    best = lambda df: [(r.query_id, r.id) for r in rt.top_k(df, "id", 3).orderBy("query_id", "rank").collect()]
    assert best(rt.bm25(docs, queries, "id", digits=6, k=3)) == best(rt.bm25(docs, queries, "id", digits=6))
    assert rt.bm25(docs, queries.limit(0), "id").count() == 0 and rt.bm25(docs.limit(0), queries, "id").count() == 0


def test_a_replayed_batch_replaces_its_own_version(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "id string, key string, digest string, updated_at long")
    write = lambda df, n: upsert.write_version(df, str(tmp_path / "t"), ["key"], "digest", "updated_at", n)
    write(batch(("1", "a", "x", 1)), 0)
    for _ in range(2):
        write(batch(("2", "a", "y", 2), ("3", "b", "z", 2)), 1)
    assert upsert._versions(spark, str(tmp_path / "t")) == [1, 2]
    assert sorted((r.id, r.key, r.digest) for r in upsert.read_snapshot(spark, str(tmp_path / "t")).collect()) == [("1", "a", "y"), ("3", "b", "z")]


def test_shared_folder_and_names(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert [n for n in ("a", " ", ".", "..", "a/b", "a\\b", "", "...") if is_folder_name(n)] == ["a", "..."]
