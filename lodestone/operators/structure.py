"""Documents as lines, blocks and sections: what windows can express stays relational, the packing of passages is a scan per document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, line_no, line) of every line, numbered from 1; \\r\\n and \\r end lines too."""
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n|\r", "\n"), "\n")
    return df.filter(F.col(text_col).isNotNull()).select(id_col, F.posexplode(lines).alias("p", "line")).select(id_col, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def line_kind(line: str = "line"):
    """heading, table, list, quote, blank or text."""
    c = F.col(line)
    return F.when(c.rlike("^#{1,6} "), "heading").when(c.rlike("^\\s*\\|.*\\|\\s*$"), "table").when(c.rlike("^\\s*(?:[-*•]|[0-9]+[.)]) "), "list").when(c.rlike("^> ?"), "quote").when(F.trim(c) == "", "blank").otherwise("text")


def sections(lines: DataFrame, id_col: str, level: int = 2) -> DataFrame:
    """(id_col, section, title, first_line, last_line): text cut at headings up to ``level``; what stands before the first is section 0 without a title.

    One window per document: a document of a third of all lines still sorts with spilling, never in Python memory.
    """
    is_cut = F.col("line").rlike(f"^#{{1,{level}}} ")
    w = Window.partitionBy(id_col).orderBy("line_no")
    numbered = lines.withColumn("section", F.sum(is_cut.cast("long")).over(w))
    return numbered.groupBy(id_col, "section").agg(F.min_by(F.when(F.col("line").rlike(f"^#{{1,{level}}} "), F.trim(F.regexp_replace("line", "^#{1,6} ", ""))), "line_no").alias("title"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def occurrences(df: DataFrame, id_col: str, title_col: str, order_col: str) -> DataFrame:
    """``df`` with occurrence: the how-manieth row of its title in its document."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(id_col, title_col).orderBy(order_col)).cast("long"))


def islands(lines: DataFrame, id_col: str, kind: str) -> DataFrame:
    """(id_col, first_line, last_line, rows): runs of neighbouring lines of one kind."""
    own = lines.filter(line_kind() == kind)
    group = F.col("line_no") - F.row_number().over(Window.partitionBy(id_col).orderBy("line_no"))
    return own.withColumn("g", group).groupBy(id_col, "g").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("rows")).drop("g")


def containing(points: DataFrame, ranges: DataFrame, id_col: str, at: str) -> DataFrame:
    """``points`` with the section whose line range holds them: an equi-join on the document, then the range."""
    return points.join(ranges, id_col).filter(F.col(at).between(F.col("first_line"), F.col("last_line")))


_BLOCK_TAGS = {"p": "paragraph", "li": "list", "tr": "table", "pre": "code", "blockquote": "quote", "figcaption": "paragraph", "div": "paragraph", "section": "paragraph"} | {f"h{k}": "heading" for k in range(1, 7)}
_SKIPPED = {"script", "style", "svg", "noscript", "head", "template"}


class _Blocks(HTMLParser):
    """Typed blocks of a page in order; cells of a table row are joined by |."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.kind, self.level, self.text, self.skip, self.cells = "paragraph", 0, [], 0, False

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip() if self.kind != "code" else "".join(self.text).strip("\n")
        if text.strip(" |"):
            self.out.append((self.kind, self.level, text))
        self.text, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _BLOCK_TAGS and not (self.kind == "table" and tag in ("p", "div", "section")):
            self.flush()
            self.kind, self.level = _BLOCK_TAGS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
        elif tag in ("td", "th"):
            self.text.append("| ")
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th"):
            self.text.append(" ")
        elif tag in _BLOCK_TAGS and not (self.kind == "table" and tag in ("p", "div", "section")):
            if tag == "tr":
                self.text.append("|")
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_blocks(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, ordinal, kind, level, text): the typed blocks of each page; null and empty pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, page in enumerate(batch.column(1).to_pylist()):
                parser = _Blocks()
                last = page.rfind(">") + 1  # no tag ends after it: the rest is text
                parser.feed(page[:last])
                parser.close()
                parser.handle_data(page[last:])
                parser.flush()
                rows += [(k, n, *b) for n, b in enumerate(parser.out, 1)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], names=["id", "ordinal", "kind", "level", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("html IS NOT NULL AND html <> ''")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ordinal int, kind string, level int, text string").withColumnRenamed("id", id_col)


def pack_blocks(blocks: list[tuple[int, int, str]], target: int, least: int) -> list[tuple[int, int]]:
    """Runs (first, last) of blocks (start, end, kind) packed up to ``target`` characters; headings open a run, runs under ``least`` join the one before."""
    runs: list[list[int]] = []
    size = 0
    for k, (start, end, kind) in enumerate(blocks):
        length = end - start
        lead_in = bool(runs) and blocks[k - 1][2] == "heading"
        if runs and kind != "heading" and (size + length <= target or lead_in):
            runs[-1][1] = k
            size += length
        else:
            if runs and size < least and kind != "heading" and len(runs) > 1:
                runs[-2][1] = runs[-1][1]
                runs.pop()
            runs.append([k, k])
            size = length
    if len(runs) > 1 and size < least:
        runs[-2][1] = runs[-1][1]
        runs.pop()
    return [tuple(r) for r in runs]


_PARAGRAPH = re.compile(r"(?:[^\n]+(?:\n(?!\s*\n)|$)?)+")


def passages(df: DataFrame, id_col: str, text_col: str, target: int = 400, least: int = 120) -> DataFrame:
    """(id_col, ordinal, char_start, char_end, body): passages of whole paragraphs with exact offsets.

    Paragraphs are set apart by blank lines; a heading line opens a passage. Bodies are substrings of the text; a
    paragraph above the target is a passage of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                blocks = [(m.start(), m.start() + len(m.group().rstrip()), "heading" if m.group().startswith("#") else "text") for m in _PARAGRAPH.finditer(text) if m.group().strip()]
                rows += [(k, n, blocks[a][0], blocks[b][1], text[blocks[a][0] : blocks[b][1]]) for n, (a, b) in enumerate(pack_blocks(blocks, target, least), 1)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.string())))], names=["id", "ordinal", "char_start", "char_end", "body"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ordinal int, char_start long, char_end long, body string").withColumnRenamed("id", id_col)


def numbered_blocks(lines: DataFrame, id_col: str) -> DataFrame:
    """Lines with kind and b, the number of their block, all by windows; blank lines left out.

    Fences toggle code (an unclosed one runs to the end, fence lines belong to their block); blank lines end a block, a heading is one by itself,
    else a block is a run of lines of one kind.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    fence = F.col("line").rlike("^\\s*(?:```|~~~)")
    fenced = lines.withColumn("fences", F.sum(fence.cast("long")).over(w)).withColumn("code", (F.col("fences") % 2 == 1) | fence)
    typed = fenced.withColumn("kind", F.when(F.col("code"), "code").otherwise(line_kind()))
    before = lambda c: F.lag(c).over(w)
    opens = fence & (F.col("fences") % 2 == 1)
    cut = before("kind").isNull() | (F.col("kind") != before("kind")) | (F.col("kind") == "heading") | opens
    return typed.withColumn("cut", cut).withColumn("b", F.sum(F.col("cut").cast("long")).over(w)).filter("kind <> 'blank'")


def markdown_blocks(lines: DataFrame, id_col: str) -> DataFrame:
    """(id_col, block, kind, first_line, last_line): typed blocks of Markdown lines."""
    blocks = numbered_blocks(lines, id_col).groupBy(id_col, "b").agg(F.first("kind").alias("kind"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return blocks.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("first_line")).cast("long").alias("block"), "kind", "first_line", "last_line")


def row_groups(lines: DataFrame, id_col: str, limit: int) -> DataFrame:
    """(id_col, first_line, group_no, header, rows, body): tables as groups of rows of about ``limit`` characters, each with the table's header to repeat.

    The header is the first row, with the rule under it if there is one. Rows share groups by their running size, so a group is never longer
    than ``limit`` and its last row; a table of one row is a header without groups.
    """
    own = lines.filter(line_kind() == "table")
    own = own.withColumn("g", F.col("line_no") - F.row_number().over(Window.partitionBy(id_col).orderBy("line_no")))
    w = Window.partitionBy(id_col, "g").orderBy("line_no")
    ruled = F.trim("line").rlike(r"^[|:\s-]*-[|:\s-]*$")
    own = own.withColumns({"n": F.row_number().over(w), "first_line": F.min("line_no").over(Window.partitionBy(id_col, "g"))})
    own = own.withColumn("head", (F.col("n") == 1) | (F.col("n") == 2) & ruled)
    size = F.when(F.col("head"), 0).otherwise(F.length("line") + 1)
    own = own.withColumn("group_no", F.floor((F.sum(size).over(w) - size) / limit).cast("long"))
    header = F.concat_ws("\n", F.max(F.when(F.col("n") == 1, F.col("line"))).over(Window.partitionBy(id_col, "g")), F.max(F.when((F.col("n") == 2) & F.col("head"), F.col("line"))).over(Window.partitionBy(id_col, "g")))
    rows = own.withColumn("header", header).filter(~F.col("head"))
    return rows.groupBy(id_col, "first_line", "group_no").agg(F.first("header").alias("header"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("body"))


def leaf_sections(lines: DataFrame, id_col: str) -> DataFrame:
    """(id_col, line_no, level, title): headings without one of a deeper level right below: the cards of a collection."""
    heads = lines.filter(F.col("line").rlike("^#{1,6} ")).select(id_col, "line_no", F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("line", "^#{1,6} ", "")).alias("title"))
    below = F.lead("level").over(Window.partitionBy(id_col).orderBy("line_no"))
    return heads.withColumn("below", below).filter(F.col("below").isNull() | (F.col("below") <= F.col("level"))).drop("below")


def bold_headings(lines: DataFrame, id_col: str, most: int = 60) -> DataFrame:
    """(id_col, line_no, title): lines that are one short run of bold text, which stand for headings."""
    text = F.regexp_extract(F.trim("line"), r"^(?:\*\*([^*]+)\*\*|__([^_]+)__)[：:]?$", 0)
    bare = F.trim(F.regexp_replace(text, r"^[*_]{2}|[*_]{2}[：:]?$", ""))
    return lines.select(id_col, "line_no", bare.alias("title")).filter((F.col("title") != "") & (F.length("title") <= most))


def callouts(lines: DataFrame, id_col: str) -> DataFrame:
    """(id_col, first_line, kind, lines, text): quotes that begin with [!KIND], their lines without the quote mark."""
    quoted = lines.filter(F.col("line").rlike("^> ?")).withColumn("g", F.col("line_no") - F.row_number().over(Window.partitionBy(id_col).orderBy("line_no")))
    bare = quoted.withColumn("bare", F.regexp_replace("line", "^> ?", ""))
    whole = bare.groupBy(id_col, "g").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "bare")))["bare"], "\n").alias("text"))
    kind = F.regexp_extract("text", r"^\[!([A-Za-z]+)\]", 1)
    return whole.select(id_col, "first_line", F.upper(kind).alias("kind"), "lines", F.trim(F.regexp_replace("text", r"^\[![A-Za-z]+\][ \t]*\n?", "")).alias("text")).filter("kind <> ''")
