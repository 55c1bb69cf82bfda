"""Registered queries of the search service and of imports: whole answers, links between tables, gates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodestone.functions import text as tx
from lodestone.operators import outline as ol, reconcile as rc, retrieval as rt, structure as st
from lodestone.plans import search as se
from lodestone.plans.catalog import _BASE, _BM25, _CONTEXTS, _COSINE, _EVIDENCE, _LINES, _SOURCES, _SPECS, _STOP, SYNONYMS, register
from lodestone.sources.tables import table

_KEYED = "keyed AS (SELECT evi.id, evi.context_id, src.source_type || ':' || src.canonical_locator || '#' || ctx.key || '#' || evi.key AS stable_key FROM evi JOIN ctx ON ctx.id = evi.context_id JOIN src ON src.id = ctx.source_id)"


@register(
    _BASE + _BM25 + ", " + _COSINE + ", " + _KEYED + """, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (20 + rank)), 8) AS score, max(CASE WHEN r = 'k' THEN rank END) AS kr, max(CASE WHEN r = 'v' THEN rank END) AS vr FROM (SELECT query_id, id, rank, 'k' AS r FROM keyword UNION ALL SELECT query_id, id, rank, 'v' FROM vector) GROUP BY query_id, id),
m AS (SELECT f.*, context_id, stable_key, row_number() OVER (PARTITION BY query_id, context_id ORDER BY score DESC, stable_key, id) AS n FROM f JOIN keyed USING (id)),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stable_key, id) AS rank FROM m WHERE n = 1),
al AS (SELECT query_id, context_id, string_agg(id || ' ' || coalesce(CAST(kr AS VARCHAR), '-') || ' ' || coalesce(CAST(vr AS VARCHAR), '-'), ',' ORDER BY n) AS matches FROM m GROUP BY query_id, context_id)
SELECT q.query_id, CASE WHEN first.context_id IS NULL THEN 'no_result' ELSE 'found' END AS status, CAST(first.rank AS BIGINT) AS rank, first.context_id, round(first.score, 6) AS score, CASE WHEN kr IS NOT NULL AND vr IS NOT NULL THEN 'keyword+vector' WHEN kr IS NOT NULL THEN 'keyword' WHEN vr IS NOT NULL THEN 'vector' END AS kind, al.matches,
ctx.title, md5(ctx.body) AS text_md5, src.title AS source_title, src.source_type || ':' || src.canonical_locator AS locator, array_to_string(list_concat(list_filter(src.warnings, lambda w: w IS NOT NULL), list_filter(coalesce(ctx.warnings, []), lambda w: NOT list_contains(src.warnings, w))), ' | ') AS warnings
FROM q LEFT JOIN first ON first.query_id = q.query_id AND first.rank <= 5 LEFT JOIN al ON al.query_id = first.query_id AND al.context_id = first.context_id LEFT JOIN ctx ON ctx.id = first.context_id LEFT JOIN src ON src.id = ctx.source_id"""
)
def search_results(spark, d):
    """What a search returns: the first parents of every query with text, source, warnings of both, and all matches with their ranks by route; queries without any have one row.

    The scope is applied again when parents are read.
    """
    config = se.SearchConfig(visibilities=rt.visible_to(True))
    corpus, by_route = se.routes(spark, d, config)
    keyed = rt.scoped_evidence(corpus.evidence, corpus.contexts, corpus.sources).select("id", "context_id", "stable_key")
    found = rt.group_matches(rt.fuse(by_route, "id", config.rrf_k), keyed, "id", "context_id", config.top_k)
    source = corpus.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.concat("source_type", F.lit(":"), "canonical_locator").alias("locator"), F.col("warnings").alias("of_source"))
    texts = rt.one_each(table(spark, d, "context_unit").select("id", "source_id", "title", F.md5("body").alias("text_md5"), "warnings"))  # bodies are neither moved nor sorted
    parents = rt.scoped_contexts(texts, corpus.sources, config.visibilities).select(F.col("id").alias("context_id"), "source_id", "title", "text_md5", F.col("warnings").alias("own")).join(source, "source_id")
    merged = F.array_distinct(F.concat(F.array_compact(F.coalesce("of_source", F.array())), F.array_compact(F.coalesce("own", F.array()))))
    place = lambda m, route: F.coalesce(m["ranks"][route].cast("string"), F.lit("-"))
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(" ", m["id"], place(m, "keyword"), place(m, "vector"))), ",")
    read = found.join(parents, "context_id").select("query_id", F.col("rank").cast("long").alias("rank"), "context_id", F.round("score", 6).alias("score"), "kind", shown.alias("matches"), "title", "text_md5", "source_title", "locator", F.array_join(merged, " | ").alias("warnings"))
    asked = se.known_item_queries(corpus, vectors=False).select("query_id")
    return asked.join(read, "query_id", "left").withColumn("status", F.when(F.col("context_id").isNull(), "no_result").otherwise("found"))


def _search_terms(text: str) -> str:
    plain = f"list_filter(list_concat(regexp_extract_all(lower({text}), '{tx.ASCII_TOKEN}'), flatten(list_transform(regexp_extract_all(lower({text}), '{tx.IDEOGRAPHS}'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))), lambda t: t NOT IN ({_STOP}))"
    return f"flatten(list_transform({plain}, lambda t: CASE WHEN len(regexp_extract_all(t, '{tx.PIECES}')) >= 2 THEN list_concat([t], list_filter(regexp_extract_all(t, '{tx.PIECES}'), lambda x: length(x) > 1)) ELSE [t] END))"


_GROUPS = "[" + ", ".join("[" + ", ".join(f"'{p}'" for p in g) + "]" for g in SYNONYMS) + "]"
_EXPANDED = f"concat_ws(' ', title, nullif(array_to_string(flatten(list_transform({_GROUPS}, lambda g: CASE WHEN list_bool_or(list_transform(g, lambda p: contains(lower(title), p))) THEN list_filter(g, lambda p: NOT contains(lower(title), p)) ELSE [] END)), ' '), ''))"


@register(
    _BASE + _KEYED + f""", doc AS (SELECT id, {_search_terms('retrieval_text')} AS terms FROM evi), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS average FROM doc), xq AS (SELECT query_id, {_EXPANDED} AS text FROM q),
asked AS (SELECT DISTINCT query_id, unnest({_search_terms('text')}) AS term FROM xq), tf AS (SELECT id, length, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM doc) GROUP BY ALL),
dfr AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
kw AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 6) AS score FROM asked JOIN tf USING (term) JOIN dfr USING (term), st GROUP BY query_id, id)
SELECT query_id, id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stable_key, id) AS rank FROM kw JOIN keyed USING (id) WHERE score >= 5) WHERE rank <= 20"""
)
def keyword_expanded(spark, d):
    """The keyword route in full: synonyms, model pieces, retrieval texts, a least score, ties by stable key."""
    corpus = se.Corpus(spark, d)
    keyed = rt.scoped_evidence(corpus.evidence, corpus.contexts, corpus.sources)
    return se.expanded_keyword_route(keyed, se.known_item_queries(corpus, vectors=False), SYNONYMS, least=5.0, k=20).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@register(_BASE + _BM25 + """, pub AS (SELECT ctx.id AS context_id FROM ctx JOIN src ON src.id = ctx.source_id WHERE src.visibility = 'public'), wide AS (SELECT query_id, id, rank FROM keyword WHERE rank <= 20), narrow AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM wide JOIN evi USING (id) JOIN pub USING (context_id))
SELECT query_id, id, CAST(wide.rank AS BIGINT) AS wide_rank, CAST(narrow.rank AS BIGINT) AS narrow_rank, CASE WHEN narrow.rank IS NULL THEN 'hidden' WHEN narrow.rank < wide.rank THEN 'up' ELSE 'same' END AS change FROM wide LEFT JOIN narrow USING (query_id, id)""")
def scope_change(spark, d):
    """What a narrower scope does to the first 20 passages of each query: which it hides, and how the others move up."""
    corpus, config = se.Corpus(spark, d), se.SearchConfig()
    wide = se.keyword_route(corpus, corpus.evidence, se.known_item_queries(corpus, vectors=False), config).filter("rank <= 20").select("query_id", "id", F.col("rank").cast("long").alias("wide_rank"))
    seen = rt.scoped_contexts(corpus.contexts, corpus.sources, rt.visible_to(False)).select(F.col("id").alias("context_id"))
    shown = corpus.evidence.select("id", "context_id").join(seen, "context_id", "left_semi").select("id", F.lit(True).alias("shown"))
    j = wide.join(shown, "id", "left")
    narrow = F.when(F.col("shown"), F.count("shown").over(Window.partitionBy("query_id").orderBy("wide_rank"))).cast("long")
    j = j.withColumn("narrow_rank", narrow)
    return j.select("query_id", "id", "wide_rank", "narrow_rank", F.when(F.col("narrow_rank").isNull(), "hidden").when(F.col("narrow_rank") < F.col("wide_rank"), "up").otherwise("same").alias("change"))


@register(f"WITH {_SOURCES}, {_CONTEXTS}, {_SPECS} SELECT spec.id AS spec_id, spec.key, ctx.id AS context_id, src.title AS source_title FROM spec JOIN ctx ON ctx.id = spec.review_context_id JOIN src ON src.id = ctx.source_id WHERE src.visibility = 'public'")
def visible_specs(spark, d):
    """Specs whose review a public reader sees, with its source; review bodies are not read."""
    c = se.Corpus(spark, d)
    return rc.visible_links(c.specs, c.contexts, c.sources, rt.visible_to(False))


_LINKED = f"WITH {_SOURCES}, {_CONTEXTS}, {_SPECS}, rev AS (SELECT DISTINCT ctx.id, regexp_replace(ctx.title, '\\s+', '', 'g') AS name FROM ctx JOIN src ON src.id = ctx.source_id WHERE src.document_schema = 'product_review'), lk AS (SELECT spec.id AS spec_id, CAST(count(rev.id) AS BIGINT) AS reviews, min(rev.id) AS one FROM spec LEFT JOIN rev ON starts_with(rev.name, regexp_replace(spec.key, '\\s+', '', 'g')) AND length(regexp_replace(spec.key, '\\s+', '', 'g')) = length(rev.name) GROUP BY spec.id)"


@register(_LINKED + " SELECT spec_id, reviews, CASE WHEN reviews = 1 THEN one END AS context_id, CASE WHEN reviews = 0 THEN 'unlinked' WHEN reviews = 1 THEN 'linked' ELSE 'failed' END AS status FROM lk")
def spec_links(spark, d):
    """Specs by the reviews whose title is their key, white space apart: none, one, or too many."""
    c = se.Corpus(spark, d)
    reviews = c.contexts.join(c.sources.filter("document_schema = 'product_review'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return rc.link_by_title(c.specs, "id", "key", reviews, "id", "title").withColumnRenamed("id", "spec_id")


@register(f"""WITH {_SPECS}, {_CONTEXTS}, q AS (SELECT spec.id, e.field, e.quote, ctx.body FROM spec, LATERAL (SELECT unnest(json_keys(evidence)) AS field, unnest(list_transform(json_keys(evidence), lambda k: json_extract_string(evidence, '$."' || k || '"'))) AS quote) e LEFT JOIN ctx ON ctx.id = spec.review_context_id)
SELECT id AS spec_id, field, ctx_state AS state FROM (SELECT id, field, CASE WHEN body IS NULL THEN 'no review' WHEN contains(regexp_replace(body, '[\\s 　]+', '', 'g'), regexp_replace(quote, '[\\s 　]+', '', 'g')) THEN 'quoted' ELSE 'missing' END AS ctx_state FROM q)""")
def spec_quotes(spark, d):
    """Whether each quote that a spec gives as evidence stands in its review, white space apart."""
    c = se.Corpus(spark, d)
    quotes = c.specs.select(F.col("id").alias("spec_id"), F.col("review_context_id").alias("context_id"), F.explode(F.from_json("evidence", "map<string,string>")).alias("field", "quote"))
    bodies = c.contexts.select(F.col("id").alias("context_id"), tx.compact(F.col("body")).alias("body"))
    state = F.when(F.col("body").isNull(), "no review").when(F.contains("body", tx.compact(F.col("quote"))), "quoted").otherwise("missing")
    return quotes.join(bodies, "context_id", "left").select("spec_id", "field", state.alias("state"))


@register(f"WITH {_SPECS}, v AS (SELECT id, brand, CASE WHEN weight_kg NOT BETWEEN 0.1 AND 10 OR screen_inch NOT BETWEEN 5 AND 30 OR (gpu IS NOT NULL AND has_dgpu IS NOT TRUE) OR review_context_id IS NULL THEN 1 ELSE 0 END AS bad FROM spec) SELECT brand, CAST(count(*) AS BIGINT) AS specs, CAST(sum(bad) AS BIGINT) AS failed, CASE WHEN sum(bad) > 0 THEN 0 ELSE count(*) END::BIGINT AS imported FROM v GROUP BY brand")
def import_gate(spark, d):
    """One file of specs a brand: any failed record keeps the whole file out."""
    within = lambda c, a, b: F.coalesce(F.col(c).between(a, b), F.lit(True))
    rules = {"weight": within("weight_kg", 0.1, 10), "screen": within("screen_inch", 5, 30), "gpu": F.col("gpu").isNull() | F.coalesce("has_dgpu", F.lit(False)), "review": F.col("review_context_id").isNotNull()}
    return rc.all_or_nothing(se.Corpus(spark, d).specs, "brand", F.size(rc.broken_rules(rules)) > 0).withColumnRenamed("rows", "specs")


@register(f"WITH {_SOURCES} SELECT DISTINCT url FROM article WHERE url IS NOT NULL AND url NOT IN (SELECT source_url FROM src WHERE source_url IS NOT NULL)")
def requested_not_found(spark, d):
    """Requested links that no source has."""
    asked = table(spark, d, "article").select("url").filter("url IS NOT NULL").distinct()
    return asked.join(se.Corpus(spark, d).sources.select(F.col("source_url").alias("url")), "url", "left_anti")


@register(f"WITH {_SOURCES}, {_CONTEXTS} SELECT DISTINCT k.id FROM (SELECT DISTINCT id, source_type, canonical_locator, content_hash, embedding_space FROM knowledge_source) k JOIN src USING (source_type, canonical_locator, content_hash, embedding_space) WHERE src.id IN (SELECT source_id FROM ctx)")
def unchanged_sources(spark, d):
    """Incoming records that are stored already: same type, locator, content and vector space, and with at least one context."""
    c = se.Corpus(spark, d)
    incoming = table(spark, d, "knowledge_source")
    return rc.unchanged(incoming, c.sources, c.contexts, ["source_type", "canonical_locator", "content_hash", "embedding_space"]).select("id").distinct()


_TESTS = {"light": "weight_kg <= 1.5", "long": "battery_hours >= 10", "oled": "panel = 'oled'", "ports": "ports.usb_c AND ports.hdmi"}


@register(f"WITH {_SPECS}, t AS (SELECT id, " + ", ".join(f"CAST(coalesce({x}, false) AS INT) AS {n}" for n, x in _TESTS.items()) + f" FROM spec) SELECT id, CAST({' + '.join(_TESTS)} AS BIGINT) AS passed, CASE WHEN {' + '.join(_TESTS)} = {len(_TESTS)} THEN 2 WHEN {' + '.join(_TESTS)} = {len(_TESTS) - 1} THEN 1 ELSE 0 END::BIGINT AS grade FROM t")
def constraint_grades(spark, d):
    """Grades of every spec under a set of constraints in which unknown is false: 2 if all hold, 1 if all but one, else 0."""
    from lodestone.functions.conditions import grade

    passed, graded = grade([F.expr(x) for x in _TESTS.values()])
    return se.Corpus(spark, d).specs.select("id", passed.cast("long").alias("passed"), graded.cast("long").alias("grade"))


_IMG = "!\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)"


@register(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_IMG}')) AS BIGINT) AS images, md5(regexp_replace(regexp_replace(text, '!\\[\\s*\\]\\([^)\\n]*\\)', '[image without description]', 'g'), '{_IMG}', '[image: \\1]', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def image_placeholders(spark, d):
    """Images per document, and its text with placeholders in their place (as a digest)."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.regexp_count("text", F.lit(tx.IMAGE)).cast("long").alias("images"), F.md5(tx.image_placeholders(F.col("text"))).alias("digest"))


@register("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|[^!])\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)', '\\1\\2', 'g'), '</?(?:font|span|a|u|center)\\b[^>\\n]*>', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def plain_links(spark, d):
    """Documents with links as their text and without anchors and style tags (as a digest)."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(tx.plain_links(F.col("text"))).alias("digest"))


@register(f"WITH {_CONTEXTS} SELECT id, md5(body) AS digest, true AS within FROM ctx WHERE body IS NOT NULL")
def budget_roundtrip(spark, d):
    """The pieces of every context put together again, and whether all stay within the byte budget with their title and header."""
    c = se.Corpus(spark, d).contexts.select("id", "title", "body")
    pieces = ol.budget_pieces(c, "id", "title", "body", 2400).join(c.select("id", F.octet_length(F.coalesce("title", F.lit(""))).alias("t")), "id")
    used = F.col("t") + 1 + F.octet_length("body") + F.when(F.col("header") != "", F.octet_length("header") + 1).otherwise(0)
    return pieces.groupBy("id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "body")))["body"], "")).alias("digest"), F.every(used <= 2400).alias("within"))


def _lines(spark, d):
    return st.text_lines(table(spark, d, "documents"), "doc_id", "text")


_ROWS = f"""{_LINES}, r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM ln WHERE NOT regexp_matches(line, '^#{{1,6}} ') AND regexp_matches(line, '^\\s*\\|.*\\|\\s*$')),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) AS n, min(line_no) OVER (PARTITION BY doc_id, g) AS first_line FROM r), h AS (SELECT *, n = 1 OR (n = 2 AND regexp_matches(trim(line), '^[|:\\s-]*-[|:\\s-]*$')) AS head FROM n),
s AS (SELECT *, CASE WHEN head THEN 0 ELSE length(line) + 1 END AS size FROM h), t AS (SELECT *, CAST(floor((sum(size) OVER (PARTITION BY doc_id, g ORDER BY line_no) - size) / 200) AS BIGINT) AS group_no, concat_ws(chr(10), max(CASE WHEN n = 1 THEN line END) OVER (PARTITION BY doc_id, g), max(CASE WHEN n = 2 AND head THEN line END) OVER (PARTITION BY doc_id, g)) AS header FROM s)"""


@register(f"WITH {_ROWS} SELECT doc_id, CAST(first_line AS BIGINT) AS first_line, group_no, any_value(header) AS header, CAST(count(*) AS BIGINT) AS rows, string_agg(line, chr(10) ORDER BY line_no) AS body FROM t WHERE NOT head GROUP BY doc_id, first_line, group_no")
def table_row_groups(spark, d):
    """Tables of the documents in groups of some 200 characters of rows, each with the header to repeat."""
    return st.row_groups(_lines(spark, d), "doc_id", 200)


@register(f"WITH {_LINES}, h AS (SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS BIGINT) AS level, trim(regexp_replace(line, '^#{{1,6}} ', '')) AS title FROM ln WHERE regexp_matches(line, '^#{{1,6}} ')) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, level, title FROM (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS below FROM h) WHERE below IS NULL OR below <= level")
def leaf_sections(spark, d):
    """Headings without a deeper one right below."""
    return st.leaf_sections(_lines(spark, d), "doc_id")


@register(f"WITH {_LINES}, b AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_extract(trim(line), '^(?:[*][*][^*]+[*][*]|__[^_]+__)[：:]?$'), '^[*_]{{2}}|[*_]{{2}}[：:]?$', '', 'g')) AS title FROM ln) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, title FROM b WHERE title <> '' AND length(title) <= 60")
def bold_headings(spark, d):
    """Lines of bold text that stand for headings."""
    return st.bold_headings(_lines(spark, d), "doc_id")


@register(f"WITH {_LINES}, q AS (SELECT doc_id, line_no, regexp_replace(line, '^> ?', '') AS bare, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM ln WHERE regexp_matches(line, '^> ?')), w AS (SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first_line, CAST(count(*) AS BIGINT) AS lines, string_agg(bare, chr(10) ORDER BY line_no) AS text FROM q GROUP BY doc_id, g) SELECT doc_id, first_line, upper(regexp_extract(text, '^\\[!([A-Za-z]+)\\]', 1)) AS kind, lines, trim(regexp_replace(text, '^\\[![A-Za-z]+\\][ \\t]*\\n?', '')) AS text FROM w WHERE regexp_matches(text, '^\\[![A-Za-z]+\\]')")
def callouts(spark, d):
    """Quotes that begin with a kind in brackets."""
    return st.callouts(_lines(spark, d), "doc_id")


@register(f"WITH {_LINES} SELECT doc_id, CAST(count_if(regexp_matches(line, '^\\s*(?:!\\[[^\\]]*\\]\\([^)]*\\)\\s*)+$')) AS BIGINT) AS dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT regexp_matches(line, '^\\s*(?:!\\[[^\\]]*\\]\\([^)]*\\)\\s*)+$')), '')) AS digest FROM ln GROUP BY doc_id")
def image_only_lines(spark, d):
    """Lines of nothing but images per document, and the document without them (as a digest)."""
    only = F.col("line").rlike(r"^\s*(?:!\[[^\]]*\]\([^)]*\)\s*)+$")
    kept = F.array_sort(F.collect_list(F.when(~only, F.struct("line_no", "line"))))["line"]
    return _lines(spark, d).groupBy("doc_id").agg(F.count_if(only).alias("dropped"), F.md5(F.array_join(kept, "\n")).alias("digest"))
