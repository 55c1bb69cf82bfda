"""Problem 3: the article of a web page, from a layout-aware rendering of the whole page.

A tree builder with implied tags reads each page as a browser would; visibility rules (attributes, inline styles and the page's own style rules for
classes and ids) drop what is not seen. The tree is laid out as the visible text blocks in reading order, which render() writes out with block
spacing, list marks and aligned table cells.
The article is then the part of that layout around the page's title: the block-level element that holds the heading which repeats the
page title, without sections of links. No word list tells bylines and notices apart: they are known by what recurs over the whole table, a block's text, its
label, its frame (label and ending) or its shape (words and numbers as such), in different articles of different accounts, and by the place
where it recurs: at the head of articles, or behind their last block of their own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.tables import materialize

# HTML element classes.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template head iframe object svg math select textarea button datalist audio video canvas map".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_CLOSES_P = _BLOCK - frozenset("html body tbody thead tfoot tr td th caption li dt dd".split())
_BESIDE = frozenset("nav aside footer header form menu dialog".split())
_KEPT = frozenset("td th li figcaption pre".split())
_MARKED = _BESIDE | _KEPT | frozenset("table tr ul ol".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})} | {t: ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*\Z()()", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|font-size\s*:\s*0(?:px|em|rem|pt|%)?\s*(?:;|$)|(?:^|;)\s*(?:height|width|max-height)\s*:\s*0(?:px)?\s*(?:;|$)|text-indent\s*:\s*-\d{3,}|(?:left|top)\s*:\s*-\d{3,}", re.I)

@dataclass(slots=True, eq=False)  # a node is itself only: comparing by content would walk the tree
class Node:
    tag: str
    parent: "Node | None" = None
    attrs: str = ""
    children: list = field(default_factory=list)
    # Set by visible_blocks(): first and last number of the subtree, what it lies in, and its visible characters, all and in links, without headings.
    first: int = 0
    last: int = 0
    lies: "Inside | None" = None
    chars: int = 0
    linked: int = 0
    listed: bool = False


@dataclass(slots=True, frozen=True)
class Inside:
    """What a block lies in, itself included: the innermost element of each kind, and how many lists and tables."""

    beside: Node | None = None
    kept: Node | None = None  # list item, cell, caption or code
    pre: Node | None = None
    item: Node | None = None
    table: Node | None = None  # the outermost
    row: Node | None = None
    cell: Node | None = None
    lists: int = 0
    tables: int = 0

    def at(self, node: Node) -> "Inside":
        tag = node.tag
        if tag not in _MARKED:
            return self
        return Inside(
            node if tag in _BESIDE else self.beside, node if tag in _KEPT else self.kept, node if tag == "pre" else self.pre, node if tag == "li" else self.item, self.table or (node if tag == "table" else None),
            self.row or (node if tag == "tr" else None), self.cell or (node if tag in ("td", "th") else None), self.lists + (tag in ("ul", "ol")), self.tables + (tag == "table"),
        )


def build_tree(page: str) -> tuple[Node, str]:
    """The tree of a page, and the text of its first title element."""
    root = Node("html")
    at, pos, title = root, 0, ""
    stop = page.rfind(">") + 1  # no tag ends after it: what looks like one there is text, as is a comment's rest
    while True:
        m = _TOKEN.search(page, pos, stop) or _OPEN_COMMENT.search(page, max(pos, stop))
        text = page[pos : m.start()] if m else page[pos:]
        if text:
            at.children.append(entities.unescape(text))
        if not m:
            break
        pos = len(page) if m.group().startswith("<!--") and not m.group().endswith("-->") else m.end()
        name = m.group(2)
        if not name:
            if m.group().startswith("<![CDATA["):
                at.children.append(m.group()[9:-3])
            continue
        name = name.lower()
        if m.group(1):
            node = at
            scope = _SIBLINGS[name][1] if name in _SIBLINGS else ()
            while node is not None and node.tag != name:
                node = None if node.tag in scope and name != node.tag else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            elif name == "p":
                at.children.append(Node("p", at))
            continue
        if name in ("html", "body"):
            continue
        if name in _CLOSES_P:
            node = at
            while node.parent is not None and node.tag not in ("p", "td", "th", "li", "table", "button") and node.tag not in _BLOCK:
                node = node.parent
            if node.tag == "p" and node.parent is not None:
                at = node.parent
        if name in _SIBLINGS:
            closes, scope = _SIBLINGS[name]
            node, last = at, None
            while node.parent is not None and node.tag not in scope:
                if node.tag in closes:
                    last = node
                node = node.parent
            if last is not None:
                at = last.parent
        child = Node(name, at, m.group(3) or "")
        at.children.append(child)
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            raw = page[pos : end.start()] if end else page[pos:]
            if name == "title" and not title:
                title = entities.unescape(raw)
            elif name == "textarea":
                child.children.append(raw)
            pos = end.end() if end else len(page)
        elif name not in _VOID and not (m.group(3) or "").endswith("/"):
            at = child
    return root, title


_PRINTED = re.compile(r"@media[^{]*\bprint\b[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", re.I)
_RULES = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"[\w-]*([.#][\w-]+)")


def style_rules(page: str) -> frozenset[str]:
    """The .classes and #ids that the page's style elements hide."""
    out: set[str] = set()
    for sheet in re.findall(r"<style\b[^>]*>(.*?)</style\s*>", page, re.S | re.I) if "<style" in page.lower() else ():
        for names, rules in _RULES.findall(_PRINTED.sub("", sheet)):
            if _HIDING.search(rules):
                out |= {m.group(1) for n in names.split(",") if (m := _SIMPLE.fullmatch(n.strip()))}
    return frozenset(out)


def _hidden(node: Node, rules: frozenset[str] = frozenset()) -> bool:
    if node.tag in _UNSEEN or node.tag == "title":
        return True
    if not node.attrs:
        return False
    for m in _ATTR.finditer(node.attrs):
        name, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name == "hidden" or name == "style" and _HIDING.search(value) or name == "type" and value.lower() == "hidden":
            return True
        if rules and (name == "class" and any("." + c in rules for c in value.split()) or name == "id" and "#" + value in rules):
            return True
    return False


@dataclass(slots=True)
class Block:
    """A visible text block: its element, text, share of it in links, whether all of it is bold."""

    node: Node
    text: str
    linked: float
    bold: bool

    @property
    def tag(self) -> str:
        return self.node.tag

    @property
    def lies(self) -> Inside:
        return self.node.lies


def visible_blocks(root: Node, rules: frozenset[str] = frozenset()) -> list[Block]:
    """The visible text blocks in reading order. Text beside child blocks is a block of its own. Nesting of any depth takes linear time."""
    out: list[Block] = []
    run: list[tuple[str, bool, bool]] = []
    number = 0

    def flush(node: Node) -> None:
        text = "".join(t for t, _, _ in run)
        size = len("".join(text.split()))
        if size:
            linked = sum(len("".join(t.split())) for t, a, _ in run if a)
            if not _is_heading(node.tag):
                node.chars += size
                node.linked += linked
            out.append(Block(node, text, linked / size, all(b or not t.strip() for t, _, b in run)))
        run.clear()

    root.lies = Inside().at(root)
    stack = [(root, root, False, False, 0)]  # element, block that its text belongs to
    while stack:
        node, block, linked, bold, k = stack.pop()
        while k < len(node.children):
            child = node.children[k]
            k += 1
            if isinstance(child, str):
                run.append((child, linked, bold))
            elif child.tag == "br":
                run.append(("\n", linked, bold))
            elif _hidden(child, rules):
                continue
            elif child.tag in _BLOCK:
                flush(block)
                number += 1
                child.first, child.lies = number, block.lies.at(child)
                stack += [(node, block, linked, bold, k), (child, child, linked, bold, 0)]
                break
            else:
                stack += [(node, block, linked, bold, k), (child, block, linked or child.tag == "a", bold or child.tag in ("b", "strong"), 0)]
                break
        else:
            if node is block:
                flush(block)
                block.last = number
                if stack:
                    above = stack[-1][1]
                    above.chars += block.chars
                    above.linked += block.linked
                    above.listed |= block.listed or block.tag == "li"
    return out


def _is_heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()


def _holds(outer: Node, inner: Node | None) -> bool:
    """Whether inner lies in outer, below it."""
    return inner is not None and outer.first < inner.first <= outer.last


def _squeezed(text: str) -> str:
    return "".join(c for c in text if not c.isspace())


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def render(page: str) -> str:
    """All visible text of a page: blocks apart by blank lines, list items marked, table cells aligned."""
    blocks = visible_blocks(build_tree(page)[0], style_rules(page))
    out: list[str] = []
    counters: dict[int, int] = {}
    k = 0
    while k < len(blocks):
        b = blocks[k]
        table = b.lies.table
        if table is not None and b.tag in ("td", "th") and b.lies.tables == 1:
            rows: dict[int, dict[int, str]] = {}
            while k < len(blocks) and blocks[k].lies.table is table:
                row, cell = id(blocks[k].lies.row), id(blocks[k].lies.cell)
                cells = rows.setdefault(row, {})
                cells[cell] = (cells.get(cell, "") + " " + " ".join(blocks[k].text.split())).strip()
                k += 1
            grid = [list(r.values()) for r in rows.values()]
            wide = [max(_width(r[c]) for r in grid if c < len(r)) for c in range(max(map(len, grid)))]
            out.append("\n".join("  ".join(t + " " * (wide[c] - _width(t)) for c, t in enumerate(r)).rstrip() for r in grid))
            continue
        text = b.text.strip("\n") if b.lies.pre is not None else "\n".join(" ".join(line.split()) for line in b.text.strip().split("\n"))
        item = b.lies.item
        if item is not None:
            depth = b.lies.lists
            mark = "- "
            if item.parent is not None and item.parent.tag == "ol":
                counters[id(item.parent)] = counters.get(id(item.parent), 0) + 1
                mark = f"{counters[id(item.parent)]}. "
            text = "  " * max(depth - 1, 0) + mark + text
            if out and out[-1].lstrip().startswith(("- ", *(f"{d}" for d in range(10)))) and k and blocks[k - 1].lies.item is not None:
                out[-1] += "\n" + text
                k += 1
                continue
        out.append(text)
        k += 1
    return "\n\n".join(out)


def _key(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def article_blocks(page: str) -> list[tuple[str, str, bool]]:
    """(text, tag, may_be_notice) of the blocks of a page's article; may_be_notice: running text whose frequency over the table decides.

    The article is the block-level element around the heading that repeats the page title (else around the first h1, else the first heading of any level);
    pages without a heading have no article, nor have those with nothing but it. Left out: what lies in nav, aside, footer, header, form or menu
    elements, sections of which all but the headings are links, and running text that is one link.
    """
    root, title = build_tree(page)
    blocks = visible_blocks(root, style_rules(page))
    wanted = _key(title)
    heads = [b for b in blocks if _is_heading(b.tag) and b.lies.beside is None or b.tag in ("h1", "h2", "h3") and b.lies.beside is not None and b.lies.beside.tag == "header"]
    upper = [b for b in heads if b.tag in ("h1", "h2", "h3")]
    repeats = lambda b: len(k := _key(b.text)) >= 4 and (wanted.startswith(k) or k in wanted)
    same = [b for b in upper if wanted and repeats(b)] or [b for b in heads if wanted and repeats(b)]
    head = next(iter(same or [b for b in heads if b.tag == "h1"]), None)
    if head is None:
        return []
    holder = head.node.parent
    while holder.parent is not None and (holder.tag in ("header", "hgroup") or holder.tag not in _BLOCK):
        holder = holder.parent
    links: dict[int, bool] = {id(holder): False}  # whether a section of links lies at or above an element

    def of_links(node: Node) -> bool:
        chain = []
        while id(node) not in links:
            chain.append(node)
            node = node.parent
        known = links[id(node)]
        for node in reversed(chain):
            known = links[id(node)] = known or node.tag in _BLOCK and node.listed and node.linked >= 0.98 * node.chars > 0
        return known

    out: list[tuple[str, str, bool]] = []
    started = False
    for b in blocks:
        if b is head:
            started = True
            out.append((b.text, b.tag, False))
        elif started and (b.node is holder or _holds(holder, b.node)) and not _holds(holder, b.lies.beside):
            kept = _holds(holder, b.lies.kept) or _is_heading(b.tag)
            if not (of_links(b.node) or b.linked > 0.999 and not kept):
                out.append((b.text, b.tag, not (kept or b.bold)))
    return out if len(out) > 1 else []


_NUMBER, _LETTERS = re.compile(r"\d+(?:[.,]\d+)*"), re.compile(r"[^\W\d_]+")
_LABEL, _ENDING = re.compile(r"\s*([^：:·|｜\n]{1,12}?)\s*[：:·|｜]"), re.compile(r"[^，,；;。.！!？?：:·|｜\s]+\W*$")


def marks(text: str) -> list[str]:
    """What may recur of a block whose text does not: its label, its frame (label and ending), and the shape of a short text with several numbers in it."""
    out = []
    if m := _LABEL.match(text):
        label = _squeezed(m.group(1))
        out.append("label " + label)
        if end := _ENDING.search(text, m.end()):
            out.append(f"frame {label} {_squeezed(end.group())}")
    if len(text) < 60:
        shape = " ".join(_LETTERS.sub("W", _NUMBER.sub("9", unicodedata.normalize("NFKC", text))).split())
        if shape.count("9") >= 2:
            out.append("shape " + shape)
    return out


def block_md5(text: str) -> str:
    return hashlib.md5(_squeezed(text).encode("utf-8", "surrogatepass")).hexdigest()


def main_blocks(df: DataFrame, id_col: str = "article_id", html_col: str = "html", group_col: str = "account", notice_groups: int = 3, notice_share: float = 0.05, edge_share: float = 0.5, shape_share: float = 0.8) -> DataFrame:
    """(id_col, block_md5, block_text, position) of the text blocks of each page's article.

    Running text (no heading, list item, cell, caption or code) is a byline or notice and left out if its text, or one of its marks(), stands in articles of
    ``notice_groups`` or more groups and of ``notice_share`` or more of all groups, in ``edge_share`` or more (a shape: ``shape_share``) of the places at an article's edge: among its first
    three blocks, or behind the last block that does not recur so itself. A frame needs no edge. Articles of one heading, or of the same two middle
    blocks, are one article fetched or posted again: a block must stand in ``notice_groups`` different ones.
    Null and empty pages, and pages without an article, give no rows; a null group has no vote. Repeated rows give
    repeated rows. Other columns are not read. Texts are written once and joined to nothing: what is counted are checksums of texts and marks.
    """

    kinds = ("text", "label", "frame", "shape")

    def number(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def marked(text: str) -> int:
        """A mark as 64 bits, the last two for its kind."""
        return number(text) & ~3 | kinds.index(text.split(" ", 1)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, md5, text, position, count, mark, title, heart = [], [], [], [], [], [], [], []
            for k, page in enumerate(batch.column(2).to_pylist()):
                article = article_blocks(page)
                keys = [block_md5(t) for t, _, _ in article]
                for p, (t, _, may) in enumerate(article):
                    row.append(k)
                    md5.append(keys[p])
                    text.append(t)
                    position.append(p)
                    count.append(len(article))
                    mark.append([marked(m) for m in ("text " + keys[p], *marks(t))] if may else [])
                if article:
                    title += [number(keys[0])] * len(article)
                    heart += [number(" ".join(keys[(len(keys) - 1) // 2 :][:2]))] * len(article)
            take = pa.array(row, pa.int64())
            columns = [*(batch.column(c).take(take) for c in (0, 1, 3)), pa.array(md5, pa.string()), pa.array(text, pa.string()), pa.array(position, pa.int32()), pa.array(count, pa.int32()), pa.array(mark, pa.list_(pa.int64())), pa.array(title, pa.int64()), pa.array(heart, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "grp", "page", "block_md5", "block_text", "position", "count", "marks", "title", "heart"])

    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(html_col).alias("html"), F.xxhash64(F.col(id_col).cast("string"), F.col(group_col).cast("string"), F.col(html_col)).alias("page")).filter("html IS NOT NULL AND html <> ''")
    fields = f"id {rows.schema['id'].dataType.simpleString()}, grp string, page long, block_md5 string, block_text string, position int, count int, marks array<long>, title long, heart long"
    blocks = materialize(rows.mapInArrow(run, fields), "pages")
    groups = blocks.agg(F.count_distinct("grp").alias("groups"))
    # Marks in three or more groups whose first articles differ; all others go no further.
    once = blocks.filter("grp IS NOT NULL").select("grp", "title", "heart", F.explode("marks").alias("mark")).groupBy("mark", "grp").agg(F.min("title").alias("title"), F.min("heart").alias("heart"))
    seen = once.groupBy("mark").agg(F.count("*").alias("g"), F.count_distinct("title").alias("titles"), F.count_distinct("heart").alias("hearts"))
    recurring = seen.filter(F.least("g", "titles", "hearts") >= notice_groups).join(F.broadcast(groups), F.col("g") >= notice_share * F.col("groups")).select("mark")
    found = blocks.select("page", "position", "count", F.explode("marks").alias("mark")).join(recurring, "mark")
    kind = lambda c: c.bitwiseAND(F.lit(3))
    # Per page: the last block of its own is the last one of which neither text nor label nor frame recurs.
    paged = found.groupBy("page").agg(F.max("count").alias("count"), F.collect_set(F.when(kind(F.col("mark")) < 3, F.col("position"))).alias("strong"), F.collect_list(F.struct("mark", "position")).alias("marks"))
    own = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.col("count") - 1), lambda p: ~F.array_contains("strong", p))), F.lit(-1))
    placed = paged.select("page", own.alias("own"), F.inline("marks"))
    edged = placed.groupBy("mark").agg(F.avg(((F.col("position") <= 2) | (F.col("position") > F.col("own"))).cast("int")).alias("edges"))
    least = F.when(kind(F.col("mark")) == 2, 0.0).when(kind(F.col("mark")) == 3, shape_share).otherwise(edge_share)
    notices = edged.filter(F.col("edges") >= least).select("mark")
    dropped = placed.join(notices, "mark", "left_semi").select("page", "position").distinct()
    kept = blocks.join(dropped, ["page", "position"], "left_anti")
    return kept.select(F.col("id").alias(id_col), "block_md5", "block_text", "position")


def rendered(df: DataFrame, id_col: str = "article_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) with all visible text of each page; null stays null, an empty page gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else render(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").select(F.col("id").alias(id_col), "text")
