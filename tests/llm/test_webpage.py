from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from lodestone.llm import webpage as wp

PAGE = """<!DOCTYPE html><html><head><title>Fan test of the year - site</title><style>p{}</style></head><body><nav><ul><li>Home<li>More</ul></nav>
<div class=main><h1>Fan&nbsp;test of the year</h1><p>Ann &middot; 2024-01-02 &middot; 阅读 5</p>
<p>First <b>para</b>graph<br>goes on.<p>Open second
<ul><li>one<li>two</ul><table><tr><th>a<th>b<tr><td>long cell<td>2</table><pre>x = 1
y = 2</pre><p style="display: none">secret</p><div hidden>also</div>
<p>扫码下载客户端</p><div><h4>You may also like</h4><ul><li><a href=/x>Other story</a></ul></div></div>
<footer>© 2024</footer></body></html>"""


def test_article_blocks():
    assert [" ".join(t.split()) for t, _, _ in wp.article_blocks(PAGE)] == ["Fan test of the year", "Ann · 2024-01-02 · 阅读 5", "First paragraph goes on.", "Open second", "one", "two", "a", "b", "long cell", "2", "x = 1 y = 2", "扫码下载客户端"]


def test_body_text_of_any_wording_stays():
    body = ["This laptop manages cookies well and keeps you signed in.", "我订阅了三年的云服务，续航测试中客户端占用很高。", "To subscribe to a data plan you need a SIM tray.", "<a href=x>A long linked phrase of this very paragraph</a> goes on.", "<span aria-hidden=true>seen</span> by all"]
    page = "<title>Any title at all</title><style>.hid, p.gone{display:none} @media print{.menu{display:none}} #x1{visibility:hidden}</style><div><h4>Any title at all</h4>" + "".join(f"<p>{t}</p>" for t in body) + "<p class='a hid'>no</p><p class=gone>no</p><p id=x1>no</p><p class=menu>menu</p><p><a href=y>Only a link</a></p></div>"
    got = [t for t, _, _ in wp.article_blocks(page)]
    assert got == ["Any title at all", body[0], body[1], body[2], "A long linked phrase of this very paragraph goes on.", "seen by all", "menu"]
    assert "no" not in wp.render(page).split() and "menu" in wp.render(page)


def test_bylines_and_notices_are_known_by_what_recurs(spark):
    rows, want = [], set()
    for k in range(12):
        names = ["Ann", "Bo", "Cy", "Di"]
        head, own = f"Title of number {k}", [f"Paragraph {c} of story {k} with {c}{k} words." for c in "abcde"]
        extra = [f"{names[k % 4]} · 2024-0{k % 9 + 1}-12 · read {k * 7}"], [f"About: writer number {'xyzuvw'[k % 6]} likes {names[k % 4]}"], ["Follow this house"], [f"Ad · {names[k % 3]} sells {'abcdefghijkl'[k]}, click here"]
        parts = [*extra[0], *own[:3], *extra[3], *own[3:], *(extra[1] if k % 2 else []), *(extra[2] if k % 3 else [])]
        rows.append((k, f"acct{k % 6}", f"<title>{head}</title><div><h1>{head}</h1>" + "".join(f"<p>{t}</p>" for t in parts) + "</div>"))
        want |= {(k, t) for t in [head, *own]}
    got = {(r.article_id, r.block_text) for r in wp.main_blocks(spark.createDataFrame(rows, "article_id long, account string, html string")).collect()}
    assert got == want


def test_rendering():
    text = wp.render(PAGE)
    assert "- one\n- two" in text and "a          b\nlong cell  2" in text and "secret" not in text and "First paragraph\ngoes on." in text
    assert "1. x\n2. y" in wp.render("<ol><li>x<li>y</ol>")


def test_placeholder_pages_have_no_article():
    assert wp.article_blocks("<html><head><title>t</title></head><body><p>请登录后查看全文</p></body></html>") == []


def test_table_and_dirt(spark):
    notice = "<p>a sentence that the whole network repeats</p>"
    rows = [(k, f"acct{k}", f"<title>Title number {k}</title><div><h1>Title number {k}</h1><p>own text {k}</p>{notice}</div>") for k in range(4)]
    rows += [(10, "x", None), (11, "x", ""), (12, None, "<"), (13, "x", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "article_id long, account string, html string").withColumn("block_md5", F.lit(1)).withColumn("free", F.lit(1))
    got = sorted((r.article_id, r.block_text) for r in wp.main_blocks(df).collect())
    assert got == sorted(x for k in range(4) for x in ((k, f"Title number {k}"), (k, f"own text {k}")))
    assert {r.article_id: r.text for r in wp.rendered(df.filter("article_id IN (10, 11)")).collect()} == {10: None, 11: ""}
    assert wp.main_blocks(df.limit(0)).count() == 0


def test_reposts_and_chance_sentences_are_no_notices(spark):
    page = "<title>{0}</title><div><h1>{0}</h1>{1}</div>"
    own = lambda k, n: [f"own text {k} {i}" for i in range(n)]
    post = own("shared", 6)
    texts = {k: ("A long posted title", post) for k in range(3)} | {k: (f"Retitled post {k}", post) for k in (3, 4, 5)}  # six accounts post one article
    texts |= {k: (f"Title number {k}", [*own(k, 4), "it is quiet.", *own(f"{k}b", 4), "follow the house rules"]) for k in range(10, 16)}
    texts[20] = ("Title number 20", [*own(20, 3), "seldom seen"])
    rows = [(k, None if k == 20 else f"acct{k}", page.format(title, "".join(f"<p>{t}</p>" for t in blocks))) for k, (title, blocks) in texts.items()]
    got = {(r.article_id, r.block_text) for r in wp.main_blocks(spark.createDataFrame(rows, "article_id long, account string, html string")).collect()}
    assert got == {(k, t) for k, (title, blocks) in texts.items() for t in [title, *blocks] if t != "follow the house rules"}


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<br>", "text ", "&amp;", "<!-- c -->", "<script>x</script>", "<", ">", "</td>", "<h1>", "</h1>", "<pre>", "</pre>"]), max_size=40))
def test_no_text_is_lost_or_repeated(parts):
    import html

    page = "".join(parts)
    blocks = wp.visible_blocks(wp.build_tree(page)[0])
    assert "".join(b.text for b in blocks).count("text") == page.replace("<!-- c -->", "").count("text") or "<" in parts
    wp.render(page), wp.article_blocks(page), html


def test_page_ends_and_depths():
    page = "<title>Long title here</title><div><h1>Long title here</h1><p>one</p>{}</div>"
    assert [b[0] for b in wp.article_blocks(page.format("<p>two") + "<!-- open <p>gone</p> trailing")] == ["Long title here", "one", "two"]
    assert wp.render("<p>a</p> b <i unclosed") == "a\n\nb <i unclosed"
    assert wp.render("<p>" + "<a " * 60_000).startswith("<a <a")
    assert wp.render("<p>x" + "<!-- " * 40_000 + "y") == "x"
    deep = page.format("<div>" * 20_000 + "<p>far below</p>")
    assert [b[0] for b in wp.article_blocks(deep)] == ["Long title here", "one", "far below"]


def test_equal_tables_stay_apart():
    page = "<table><tr><td>a<td>b<tr><td>longer<td>c</table>"
    assert wp.render(page + page) == "a       b\nlonger  c\n\na       b\nlonger  c"
