"""Text expressions: tokens, keys, normalisers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# What a search term is (words of letters and digits, joined by signs that occur inside model names, with the signs that may end them;
# runs of ideographs of two blocks), what a model name falls into, and the words that are no terms.
WORD, JOINERS, ENDINGS = "[a-z0-9]+", "[._%+#/-]", ("\\+\\+", "[%+#]")
ASCII_TOKEN = f"{WORD}(?:{JOINERS}{WORD})*(?:{'|'.join(ENDINGS)})?"
IDEOGRAPHS = "[㐀-䶿一-鿿]+"
PIECES = "[a-z]+|[0-9]+(?:\\.[0-9]+)*\\+?"
STOP_WORDS = tuple("的 了 吗 呢 啊 是 有 这 那 这个 那个 这台 那台 台 怎么 怎么样 如何 能 用 多久 很 我 你".split())
#: Of our own: English words that no search is for, and two Chinese ones.
STOP_WORDS += tuple("the a an of and to in on is was for with 和 在".split())


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Search terms of a text, repetitions kept: Latin tokens, and pairs of neighbouring ideographs (a lone one as itself)."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(ASCII_TOKEN), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(IDEOGRAPHS), F.lit(0)), pairs))
    return F.filter(F.concat(latin, han), lambda t: ~t.isin(*stop)) if stop else F.concat(latin, han)


def model_pieces(token: Column) -> Column:
    """A mixed token and its letter and number pieces longer than one character, when there are at least two; else no pieces."""
    pieces = F.regexp_extract_all(F.lower(token), F.lit(PIECES), F.lit(0))
    return F.when(F.size(pieces) >= 2, F.concat(F.array(F.lower(token)), F.filter(pieces, lambda p: F.length(p) > 1))).otherwise(F.array().cast("array<string>"))


def search_terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """tokens(), and after each model name its pieces."""
    cut = F.transform(tokens(text, stop), lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(PIECES), F.lit(0)).alias("p")))
    return F.flatten(F.transform(cut, lambda c: F.when(F.size(c["p"]) >= 2, F.concat(F.array(c["t"]), F.filter(c["p"], lambda p: F.length(p) > 1))).otherwise(F.array(c["t"]))))


def expand_synonyms(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """The text, and after it the absent members of every group of which it has a member."""
    low, added = F.lower(text), []
    for group in groups:
        has = [F.contains(low, F.lit(p)) for p in group]
        hit = reduce(Column.__or__, has)
        added += [F.when(hit & ~h, F.lit(p)) for p, h in zip(group, has)]
    return F.concat_ws(" ", text, *added)


def parse_synonyms(lines: str) -> tuple[tuple[str, ...], ...]:
    """Groups of a synonym file: phrases apart by commas, one group a line, # begins a comment; phrases of one character and groups of one phrase are refused."""
    out = []
    for number, line in enumerate(lines.splitlines(), 1):
        phrases = tuple(p.strip().lower() for p in line.split("#")[0].replace("，", ",").split(",") if p.strip())
        if phrases and (len(phrases) < 2 or min(map(len, phrases)) < 2):
            raise ValueError(f"line {number}: a group needs two phrases of two characters")
        if phrases:
            out.append(phrases)
    return tuple(out)


IMAGE = r"!\[([^\]\n]*)\]\([^)\n]*\)"
LINK = r"\[([^\]\n]*)\]\([^)\n]*\)"
MARKUP = r"</?(?:font|span|a|u|center)\b[^>\n]*>"


def image_placeholders(text: Column, unnamed: str = "image without description") -> Column:
    """Markdown images as [image: description], or [unnamed]."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[\s*\]\([^)\n]*\)", f"[{unnamed}]"), IMAGE, "[image: $1]")


def plain_links(text: Column) -> Column:
    """Markdown links as their text, anchors and style tags gone; images stay."""
    return F.regexp_replace(F.regexp_replace(text, "(?<!!)" + LINK, "$1"), MARKUP, "")


def stable_key(source_type: Column, locator: Column, context_key: Column, evidence_key: Column) -> Column:
    """type:locator#context#evidence; null if any part is."""
    return F.concat(source_type, F.lit(":"), locator, F.lit("#"), context_key, F.lit("#"), evidence_key)


def hashed_key(prefix: str, title: Column, occurrence: Column) -> Column:
    """prefix-<16 hex digits of the title's SHA-256>, with -n from the second occurrence on."""
    base = F.concat(F.lit(prefix + "-"), F.substring(F.sha2(title, 256), 1, 16))
    return F.when(occurrence > 1, F.concat(base, F.lit("-"), occurrence.cast("string"))).otherwise(base)


def retrieval_text(title: Column, prefix: Column, body: Column) -> Column:
    """Title, prefix if any, and body, each on its own line."""
    return F.concat_ws("\n", title, F.nullif(prefix, F.lit("")), body)


def clean_title(title: Column, label: int = 20, marks: str = " \t\r\n　⭐") -> Column:
    """Without a beginning of 【...】 groups, a label of at most ``label`` characters before a bar, and stars and blanks at the end."""
    body = F.regexp_replace(F.trim(title), r"\A(?:【[^】]*】|\s)+", "")
    bar = F.regexp_instr(body, F.lit("[|｜]"))
    return F.rtrim(F.when(bar.between(1, label + 1), F.regexp_replace(F.substr(body, bar + 1), r"\A\s+", "")).otherwise(body), F.lit(marks))


def compact(text: Column) -> Column:
    """Without any whitespace."""
    return F.regexp_replace(text, r"[\s 　]+", "")


def gpu_name(gpu: Column) -> Column:
    """RTX and GTX numbers in one spelling (RTX 5070Ti), however they are spaced and cased; other names with single spaces."""
    part = lambda k: F.regexp_extract(F.upper(compact(gpu)), r"^([RG]TX)([0-9]+)(TI)?$", k)
    plain = F.trim(F.regexp_replace(gpu, r"\s+", " "))
    return F.when(part(1) != "", F.concat(part(1), F.lit(" "), part(2), F.when(part(3) != "", "Ti").otherwise(""))).otherwise(plain)


def article_identity(url: Column, key: Column, host: str) -> Column:
    """mp:<biz>:<mid>:<idx> from the query of a permanent link, mp:s:<slug> from a short one; capture:<key> without a link; null for links of other forms or hosts.

    host: pattern of the hosts. Links copied from page sources may hold &amp; for &.
    """
    link = F.replace(F.trim(url), F.lit("&amp;"), F.lit("&"))
    ask = lambda k: F.try_url_decode(F.coalesce(F.try_parse_url(link, F.lit("QUERY"), F.lit(k)), F.lit("")))
    path, known = F.try_parse_url(link, F.lit("PATH")), F.try_parse_url(link, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(link, F.lit("HOST")).rlike(host)
    permanent = (path == "/s") & ask("__biz").rlike("^[A-Za-z0-9+/=]+$") & ask("mid").rlike("^[0-9]+$") & ask("idx").rlike("^[0-9]+$")
    short = F.regexp_extract(path, "^/s/([A-Za-z0-9_-]+)$", 1)
    linked = F.when(permanent, F.concat_ws(":", F.lit("mp"), ask("__biz"), ask("mid"), ask("idx"))).when(short != "", F.concat(F.lit("mp:s:"), short))
    return F.when(url.isNull(), F.concat(F.lit("capture:"), key)).when(known, linked)


def url_identity(url: Column) -> Column:
    """host:path without scheme, query and fragment, in lower-case host; null for anything but http(s)."""
    m = lambda g: F.regexp_extract(url, r"^https?://([^/?#]+)([^?#]*)", g)
    return F.when(url.rlike("^https?://[^/?#]"), F.concat(F.lower(m(1)), F.lit(":"), F.regexp_replace(m(2), "/+$", "")))


def shorten(text: Column, most: int = 200, tail: int = 100) -> Column:
    """The first ``most - tail - 1`` and the last ``tail`` characters with an ellipsis between, if longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - tail - 1)), F.lit("…"), F.right(text, F.lit(tail)))).otherwise(text)


def tidy_lines(text: Column) -> Column:
    """Runs of tabs, spaces and no-break spaces as one space, lines trimmed."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[\t  ]+", " "))), "\n")


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the columns in order; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
