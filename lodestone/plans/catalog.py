"""The registered queries of the core: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import conditions as cond, text as tx
from lodestone.operators import evaluation as ev, outline as ol, reconcile as rc, retrieval as rt, structure as st
from lodestone.plans import search as se
from lodestone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

# Pieces of SQL shared by the oracles.
_SOURCES = "src AS (SELECT * FROM knowledge_source QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_CONTEXTS = "ctx AS (SELECT DISTINCT ON (id) * FROM context_unit ORDER BY id)"
_EVIDENCE = "evi AS (SELECT DISTINCT ON (id) * FROM evidence_unit ORDER BY id)"
_SPECS = "spec AS (SELECT * FROM product_spec QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms(text: str) -> str:
    return (
        f"list_filter(list_concat(regexp_extract_all(lower({text}), '{tx.ASCII_TOKEN}'), flatten(list_transform(regexp_extract_all(lower({text}), '{tx.IDEOGRAPHS}'), "
        f"lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))), lambda t: t NOT IN ({_STOP}))"
    )


_LINES = "ln AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS p FROM documents WHERE text IS NOT NULL))"
_VALID = "(len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"


def register(sql: str | None = None):
    def add(function: Query) -> Query:
        CATALOG[function.__name__] = (function, sql)
        return function

    return add


# ---- scope, keys, joins -------------------------------------------------------------------------------------------------------


@register(f"WITH {_SOURCES}, {_CONTEXTS} SELECT ctx.id, ctx.source_id FROM ctx JOIN src ON src.id = ctx.source_id WHERE src.visibility IN ('public')")
def scoped_contexts(spark, d):
    c = se.Corpus(spark, d)
    return rt.scoped_contexts(c.contexts, c.sources, ["public"]).select("id", "source_id")


@register(f"WITH {_SOURCES}, {_CONTEXTS}, {_EVIDENCE} SELECT evi.id, src.source_type || ':' || src.canonical_locator || '#' || ctx.key || '#' || evi.key AS stable_key FROM evi JOIN ctx ON ctx.id = evi.context_id JOIN src ON src.id = ctx.source_id")
def stable_keys(spark, d):
    c = se.Corpus(spark, d)
    return rt.scoped_evidence(c.evidence, c.contexts, c.sources).select("id", "stable_key")


@register(f"""WITH {_CONTEXTS}, {_EVIDENCE} SELECT context_id, CAST(count(*) AS BIGINT) AS passages, CAST(count_if(contains(c, e)) AS BIGINT) AS contained FROM
(SELECT evi.context_id, regexp_replace(evi.body, '[\\s 　]+', '', 'g') AS e, regexp_replace(ctx.body, '[\\s 　]+', '', 'g') AS c FROM evi JOIN ctx ON ctx.id = evi.context_id) GROUP BY context_id""")
def quote_containment(spark, d):
    """How many passages of each context stand in its body, whitespace apart: bodies shuffle once, on the context."""
    c = se.Corpus(spark, d)
    j = c.evidence.select("context_id", tx.compact(F.col("body")).alias("e")).join(c.contexts.select(F.col("id").alias("context_id"), tx.compact(F.col("body")).alias("c")), "context_id")
    return j.groupBy("context_id").agg(F.count("*").alias("passages"), F.count_if(F.contains("c", "e")).alias("contained"))


@register(f"WITH {_EVIDENCE} SELECT id, context_id, CAST(n AS BIGINT) AS n FROM (SELECT id, context_id, row_number() OVER (PARTITION BY context_id ORDER BY ordinal, id) AS n FROM evi) WHERE n <= 3")
def leading_passages(spark, d):
    c = se.Corpus(spark, d)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("context_id").orderBy("ordinal", "id"))
    return c.evidence.select("id", "context_id", n.cast("long").alias("n")).filter("n <= 3")


# ---- terms and search ---------------------------------------------------------------------------------------------------------


@register(f"WITH {_EVIDENCE}, t AS (SELECT id, unnest({_terms('body')}) AS term FROM evi) SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT id) AS BIGINT) AS df FROM t GROUP BY term")
def term_statistics(spark, d):
    e = se.Corpus(spark, d).evidence
    per = rt.with_terms(e, "id", F.col("body")).select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@register(f"WITH {_EVIDENCE} SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS terms, round(avg(n), 6) AS average, CAST(count_if(n = 0) AS BIGINT) AS empty FROM (SELECT len({_terms('body')}) AS n FROM evi)")
def length_statistics(spark, d):
    lengths = rt.with_terms(se.Corpus(spark, d).evidence, "id", F.col("body"))
    return lengths.agg(F.count("*").alias("documents"), F.sum("length").alias("terms"), F.round(F.avg("length"), 6).alias("average"), F.count_if(F.col("length") == 0).alias("empty"))


@register(f"SELECT id, list_concat([lower(t)], list_filter(p, lambda x: length(x) > 1)) AS pieces FROM (SELECT id, t, regexp_extract_all(lower(t), '{tx.PIECES}') AS p FROM (SELECT DISTINCT id, unnest(regexp_extract_all(key, '[A-Za-z0-9.+-]+')) AS t FROM product_spec)) WHERE len(p) >= 2")
def model_pieces(spark, d):
    t = table(spark, d, "product_spec").select("id", F.explode(F.regexp_extract_all("key", F.lit("[A-Za-z0-9.+-]+"), F.lit(0))).alias("t")).distinct()
    return t.select("id", tx.model_pieces(F.col("t")).alias("pieces")).filter(F.size("pieces") > 0)


_QUERIES = "q AS (SELECT id AS query_id, title FROM src WHERE ('0x' || substr(id, 1, 8))::BIGINT % 20 = 0)"
_BM25 = f"""doc AS (SELECT id, {_terms('body')} AS terms FROM evi), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS average FROM doc),
asked AS (SELECT DISTINCT query_id, unnest({_terms('title')}) AS term FROM q),
tf AS (SELECT id, length, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM doc) GROUP BY ALL),
dfr AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
kw AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 6) AS score FROM asked JOIN tf USING (term) JOIN dfr USING (term), st GROUP BY query_id, id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kw WHERE score > 0 QUALIFY rank <= 100)"""
_COSINE = f"""val AS (SELECT id, context_id, embedding FROM evi WHERE {_VALID}), qv AS (SELECT q.query_id, min_by(val.embedding, val.id) AS v FROM q JOIN ctx ON ctx.source_id = q.query_id JOIN val ON val.context_id = ctx.id GROUP BY q.query_id),
vec AS (SELECT query_id, id, round(list_cosine_similarity(embedding, v), 6) AS score FROM val, qv), vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 100)"""
_BASE = f"WITH {_SOURCES}, {_CONTEXTS}, {_EVIDENCE}, {_QUERIES}, "
_FUSED = "fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (20 + rank)), 8) AS score FROM (SELECT query_id, id, rank FROM keyword UNION ALL SELECT query_id, id, rank FROM vector) GROUP BY query_id, id)"
_PARENTS = "par AS (SELECT query_id, context_id, max(score) AS score, CAST(count(*) AS BIGINT) AS hits FROM fused JOIN evi USING (id) GROUP BY query_id, context_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id) AS rank FROM par)"


@register(_BASE + _BM25 + " SELECT query_id, id, score, CAST(rank AS BIGINT) AS rank FROM keyword")
def bm25_search(spark, d):
    c, config = se.Corpus(spark, d), se.SearchConfig()
    return se.keyword_route(c, c.evidence, se.known_item_queries(c, vectors=False), config).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@register(_BASE + _COSINE + " SELECT query_id, id, score, CAST(rank AS BIGINT) AS rank FROM vector")
def cosine_search(spark, d):
    c, config = se.Corpus(spark, d), se.SearchConfig()
    return se.vector_route(c.evidence, se.known_item_queries(c), config).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@register(_BASE + _COSINE + " SELECT query_id, id FROM vector WHERE score >= 0.6")
def cosine_threshold(spark, d):
    c, config = se.Corpus(spark, d), se.SearchConfig()
    return se.vector_route(c.evidence, se.known_item_queries(c), config).filter("score >= 0.6").select("query_id", "id")


@register(_BASE + _BM25 + ", " + _COSINE + ", " + _FUSED + ", " + _PARENTS + " SELECT query_id, CAST(rank AS BIGINT) AS rank, context_id, round(score, 6) AS score, hits, title FROM top JOIN ctx ON ctx.id = top.context_id WHERE rank <= 5")
def hybrid_search(spark, d):
    return se.hybrid_search(spark, d).withColumn("score", F.round("score", 6))


@register(f"WITH {_EVIDENCE} SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'width' WHEN {_VALID} THEN 'valid' WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'not finite' ELSE 'zero' END AS state, CAST(count(*) AS BIGINT) AS rows FROM evi GROUP BY state")
def vector_validation(spark, d):
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) != 64, "width").when(rt.valid_vector(v, 64), "valid").when(bad, "not finite").otherwise("zero")
    return se.Corpus(spark, d).evidence.groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


SYNONYMS = (("续航", "电池"), ("噪声", "啸叫"), ("battery", "runtime"), ("屏幕", "面板", "显示器"), ("fan", "noise"))


def _synonym_sql() -> str:
    lists = "[" + ", ".join("[" + ", ".join(f"'{p}'" for p in g) + "]" for g in SYNONYMS) + "]"
    return f"""SELECT item_id, concat_ws(' ', text, nullif(array_to_string(flatten(list_transform({lists}, lambda g: CASE WHEN list_bool_or(list_transform(g, lambda p: contains(lower(text), p))) THEN list_filter(g, lambda p: NOT contains(lower(text), p)) ELSE [] END)), ' '), '')) AS expanded FROM eval_item WHERE text IS NOT NULL"""


@register(_synonym_sql().replace("eval_item", "(SELECT doc_id AS item_id, text FROM documents)").replace("item_id, concat", "item_id AS doc_id, concat"))
def synonym_expansion(spark, d):
    """Absent members of every group of which the text has a member are appended."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.expand_synonyms(F.col("text"), SYNONYMS).alias("expanded"))


# ---- evaluation ---------------------------------------------------------------------------------------------------------------

_JUDGED = "rel AS (SELECT q.query_id, ctx.id AS context_id, CASE WHEN ctx.ordinal = 1 THEN 2 ELSE 1 END AS grade FROM q JOIN ctx ON ctx.source_id = q.query_id)"


def _run(spark, d, rrf_k: int = 20):
    config = se.SearchConfig(rrf_k=rrf_k, top_k=1000)
    corpus, by_route = se.routes(spark, d, config)
    queries = se.known_item_queries(corpus, vectors=False).select("query_id")
    judged = corpus.contexts.select(F.col("source_id").alias("query_id"), F.col("id").alias("context_id"), F.when(F.col("ordinal") == 1, 2).otherwise(1).alias("grade")).join(queries, "query_id", "left_semi")
    ranked = lambda routes: rt.group_parents(rt.fuse(routes, "id", rrf_k), corpus.evidence, "id", "context_id", 1000)
    return by_route, queries, judged, ranked


_FIRST = "fr AS (SELECT q.query_id, (SELECT min(rank) FROM top JOIN rel USING (query_id, context_id) WHERE top.query_id = q.query_id) AS rank FROM q)"


@register(_BASE + _BM25 + ", " + _COSINE + ", " + _FUSED + ", " + _PARENTS + ", " + _JUDGED + ", " + _FIRST + " SELECT round(avg(coalesce(CAST(rank <= 1 AS INT), 0)), 6) AS hit1, round(avg(coalesce(CAST(rank <= 5 AS INT), 0)), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr10, CAST(count(*) AS BIGINT) AS queries FROM fr")
def hit_metrics(spark, d):
    by_route, queries, judged, ranked = _run(spark, d)
    first = ev.first_relevant(ranked(by_route), judged, queries, "context_id")
    return first.agg(*ev.hit_columns(F.col("rank")), F.count("*").alias("queries"))


@register(
    _BASE + _BM25 + ", " + _COSINE + ", " + _FUSED + ", " + _PARENTS + ", " + _JUDGED + """, ideal AS (SELECT query_id, CAST(count(*) AS BIGINT) AS relevant, sum(CASE WHEN i <= 5 THEN (power(2.0, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, context_id) AS i FROM rel) GROUP BY query_id),
got AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN (power(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count_if(rank <= 5) AS in_k, count_if(rank <= 10) AS in_r FROM top JOIN rel USING (query_id, context_id) GROUP BY query_id)
SELECT query_id, round(coalesce(in_k, 0) / least(relevant, 5), 6) AS p, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(in_r, 0) / least(relevant, 10), 6) AS recall FROM ideal LEFT JOIN got USING (query_id)"""
)
def graded_metrics(spark, d):
    by_route, _, judged, ranked = _run(spark, d)
    return ev.graded(ranked(by_route), judged, "context_id")


@register(
    _BASE + _BM25 + ", " + _COSINE + ", " + _FUSED + ", " + _PARENTS + ", " + _JUDGED + ", " + _FIRST + """, one AS (SELECT q.query_id, (SELECT count(*) FROM keyword JOIN evi USING (id) JOIN rel ON rel.query_id = keyword.query_id AND rel.context_id = evi.context_id WHERE keyword.query_id = q.query_id) AS kr, (SELECT count(*) FROM vector JOIN evi USING (id) JOIN rel ON rel.query_id = vector.query_id AND rel.context_id = evi.context_id WHERE vector.query_id = q.query_id) AS vr FROM q)
SELECT coalesce(failure, 'none') AS failure, CAST(count(*) AS BIGINT) AS queries FROM (SELECT CASE WHEN kr = 0 AND vr = 0 THEN 'recall' WHEN rank IS NULL OR rank > 5 THEN 'ranking' END AS failure FROM one JOIN fr USING (query_id)) GROUP BY failure"""
)
def failure_attribution(spark, d):
    by_route, queries, judged, ranked = _run(spark, d)
    first = lambda routes: ev.first_relevant(ranked(routes), judged, queries, "context_id")
    out = ev.failures(first({"keyword": by_route["keyword"]}), first({"vector": by_route["vector"]}), first(by_route))
    return out.groupBy(F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count("*").alias("queries"))


def _first_of(k: int) -> str:
    """SQL of the first relevant rank of each query under a fusion constant."""
    return f"""(SELECT q.query_id, min(t.rank) AS rank FROM q LEFT JOIN (SELECT query_id, context_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id) AS rank FROM (SELECT query_id, context_id, max(score) AS score FROM
(SELECT query_id, id, round(sum(1.0::DOUBLE / ({k} + rank)), 8) AS score FROM (SELECT query_id, id, rank FROM keyword UNION ALL SELECT query_id, id, rank FROM vector) GROUP BY query_id, id) f JOIN evi USING (id) GROUP BY query_id, context_id)) t
ON t.query_id = q.query_id AND EXISTS (SELECT 1 FROM rel WHERE rel.query_id = q.query_id AND rel.context_id = t.context_id) GROUP BY q.query_id)"""


@register(_BASE + _BM25 + ", " + _COSINE + ", " + _JUDGED + f" SELECT query_id, CAST(a.rank AS BIGINT) AS base_rank, CAST(b.rank AS BIGINT) AS other_rank, CASE WHEN coalesce(b.rank, 9999999) < coalesce(a.rank, 9999999) THEN 'better' WHEN coalesce(b.rank, 9999999) > coalesce(a.rank, 9999999) THEN 'worse' ELSE 'same' END AS change FROM {_first_of(20)} a JOIN {_first_of(60)} b USING (query_id)")
def run_comparison(spark, d):
    """First ranks under two fusion constants, query by query."""
    by_route, queries, judged, _ = _run(spark, d)
    runs = rt.first_ranks_by_constant(by_route, se.Corpus(spark, d).evidence, judged, queries, "id", "context_id", (20, 60))
    return runs.select("query_id", F.col("rank_20").cast("long").alias("base_rank"), F.col("rank_60").cast("long").alias("other_rank"), ev.change(F.col("rank_20"), F.col("rank_60")).alias("change"))


@register("SELECT CASE WHEN grouping(cat) = 1 THEN 'ALL' ELSE cat END AS cat, CAST(count(*) AS BIGINT) AS items, CAST(min(coalesce(length(text), 0)) AS BIGINT) AS least, CAST(max(coalesce(length(text), 0)) AS BIGINT) AS most, round(avg(coalesce(length(text), 0)), 6) AS mean FROM (SELECT source AS cat, text FROM documents) GROUP BY GROUPING SETS ((cat), ())")
def category_summary(spark, d):
    """Counts and sizes by source (null is a group of its own) and over all documents, in one pass of grouping sets."""
    docs = table(spark, d, "documents").select(F.col("source").alias("cat"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    summed = docs.rollup("cat").agg(F.grouping("cat").alias("total"), F.count("*").alias("items"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    return summed.withColumn("cat", F.when(F.col("total") == 1, "ALL").otherwise(F.col("cat"))).drop("total")


@register("SELECT (doc_id % 2 = 1) AS odd, CAST(count(*) AS BIGINT) AS documents, CAST(count(text) AS BIGINT) AS texts FROM documents GROUP BY odd")
def odd_even_halves(spark, d):
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 2 == 1).alias("odd")).agg(F.count("*").alias("documents"), F.count("text").alias("texts"))


# ---- conditions ---------------------------------------------------------------------------------------------------------------


def _conditions() -> dict:
    return {
        "light": cond.at_most("weight_kg", 1.5), "large": cond.at_least("screen_inch", 15.0), "lasting": cond.at_least("battery_hours", 8.0),
        "gpu": cond.one_of("gpu", ["RTX 4060", "RTX 4070"], known_false=~F.col("has_dgpu")), "ports": cond.has_all("ports", ["hdmi", "usb_c"]),
    }


_COND_SQL = {
    "light": "weight_kg <= 1.5", "large": "screen_inch >= 15", "lasting": "battery_hours >= 8",
    "gpu": "CASE WHEN gpu IS NULL AND coalesce(NOT has_dgpu, false) THEN false ELSE gpu IN ('RTX 4060', 'RTX 4070') END", "ports": "coalesce(ports.hdmi, false) AND coalesce(ports.usb_c, false)",
}
_LOOSE_SQL = {"weight_kg": "weight_kg <= 3.5", "screen_inch": "screen_inch >= 12", "battery_hours": "battery_hours >= 2", "is_gaming": "is_gaming OR NOT is_gaming"}


@register(f"WITH {_SPECS} SELECT id, " + ", ".join(f"({s}) AS c_{n}" for n, s in _COND_SQL.items()) + " FROM spec")
def three_valued_conditions(spark, d):
    return cond.evaluate(se.Corpus(spark, d).specs, _conditions()).select("id", *(f"c_{n}" for n in _COND_SQL))


@register(f"WITH {_SPECS} SELECT id, key FROM spec WHERE ({_COND_SQL['light']}) AND ({_COND_SQL['ports']})")
def conjunctive_match(spark, d):
    c = _conditions()
    return cond.matching(se.Corpus(spark, d).specs, {n: c[n] for n in ("light", "ports")}).select("id", "key")


@register(f"WITH {_SPECS} " + " UNION ALL ".join(f"SELECT '{n}' AS condition, CAST(count(*) AS BIGINT) AS total, CAST(count_if({s}) AS BIGINT) AS matched, CAST(count_if(NOT ({s})) AS BIGINT) AS failed, CAST(count(*) - count_if({s}) - count_if(NOT ({s})) AS BIGINT) AS unknown FROM spec" for n, s in _COND_SQL.items()))
def condition_diagnostics(spark, d):
    return cond.diagnostics(se.Corpus(spark, d).specs, _conditions())


@register(
    f"WITH {_SPECS} SELECT u[1] AS field, CAST(count(*) AS BIGINT) AS rows FROM (SELECT list_distinct(list_filter([" + ", ".join(f"CASE WHEN ({s}) IS NULL THEN '{n}' END" for n, s in _LOOSE_SQL.items()) + "], lambda x: x IS NOT NULL)) AS u FROM spec WHERE " + " AND ".join(f"coalesce({s}, true)" for s in _LOOSE_SQL.values()) + ") WHERE len(u) = 1 GROUP BY field"
)
def unknown_fields(spark, d):
    loose = {"weight_kg": cond.at_most("weight_kg", 3.5), "screen_inch": cond.at_least("screen_inch", 12.0), "battery_hours": cond.at_least("battery_hours", 2.0), "is_gaming": F.col("is_gaming") | ~F.col("is_gaming")}
    return cond.unknown_counts(se.Corpus(spark, d).specs, {n: (n, c) for n, c in loose.items()})


@register(f"WITH {_SPECS} SELECT id, brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY price_date DESC NULLS LAST, key, id) AS BIGINT) AS place FROM spec")
def newest_first(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc_nulls_last("price_date"), "key", "id"))
    return se.Corpus(spark, d).specs.select("id", "brand", place.cast("long").alias("place"))


@register(f"WITH {_SPECS}, a AS (SELECT id FROM spec WHERE {_COND_SQL['light']}), b AS (SELECT id FROM spec WHERE weight_kg IS NOT NULL AND NOT (weight_kg > 1.5)) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) = 0 AND (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS equal")
def set_equality(spark, d):
    s = se.Corpus(spark, d).specs
    a, b = s.filter(_conditions()["light"]).select("id"), s.filter("weight_kg IS NOT NULL AND NOT (weight_kg > 1.5)").select("id")
    left, right = (x.exceptAll(y).agg(F.count("*").alias("n")) for x, y in ((a, b), (b, a)))
    return left.crossJoin(right.withColumnRenamed("n", "m")).select(((F.col("n") == 0) & (F.col("m") == 0)).alias("equal"))


# ---- upsert, difference, reconciliation ---------------------------------------------------------------------------------------

_FIRST_SRC = "old AS (SELECT * FROM knowledge_source WHERE created_at < TIMESTAMP '2025-01-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1)"


def _versions(spark, d):
    s = table(spark, d, "knowledge_source")
    old = s.filter(F.col("created_at") < F.lit("2025-01-01").cast("timestamp"))
    rest = [c for c in s.columns if c != "id"]
    first = old.groupBy("id").agg(F.min_by(F.struct(*rest), "updated_at").alias("row")).select("id", "row.*")
    return rt.current(s), first


@register(f"WITH {_SOURCES}, {_FIRST_SRC} SELECT coalesce(src.id, old.id) AS id, CASE WHEN old.id IS NULL THEN 'created' WHEN src.id IS NULL THEN 'absent' WHEN src.content_hash IS NOT DISTINCT FROM old.content_hash THEN 'unchanged' ELSE 'updated' END AS action FROM src FULL JOIN old ON old.id = src.id")
def upsert_plan(spark, d):
    new, old = _versions(spark, d)
    return rc.upsert_plan(new, old, ["id"], "content_hash")


@register(f"WITH {_SOURCES}, {_FIRST_SRC}, u AS (SELECT src.id, src.title, src.content_hash, src.updated_at FROM src LEFT JOIN old ON old.id = src.id WHERE old.id IS NULL OR old.content_hash IS DISTINCT FROM src.content_hash), k AS (SELECT id, title, content_hash, updated_at FROM old WHERE id NOT IN (SELECT id FROM u)) FROM u UNION ALL FROM k")
def upsert_result(spark, d):
    new, old = _versions(spark, d)
    return rc.apply_upsert(new, old, ["id"], "content_hash").select("id", "title", "content_hash", "updated_at")


@register(f"""WITH {_SPECS}, old AS (SELECT * FROM product_spec WHERE updated_at < (SELECT median(updated_at) FROM product_spec) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1) SELECT coalesce(spec.id, old.id) AS id, CASE WHEN old.id IS NULL THEN 'created' WHEN spec.id IS NULL THEN 'deleted'
WHEN (spec.key, spec.weight_kg, spec.gpu, spec.note) IS DISTINCT FROM (old.key, old.weight_kg, old.gpu, old.note) THEN 'updated' ELSE 'unchanged' END AS status FROM spec FULL JOIN old ON old.id = spec.id""")
def snapshot_difference(spark, d):
    """The current spec table against its state at the median update."""
    s = table(spark, d, "product_spec")
    middle = s.agg(F.median(F.unix_micros("updated_at")).alias("m"))
    rest = [c for c in s.columns if c != "id"]
    old = s.join(F.broadcast(middle), F.unix_micros("updated_at") < F.col("m")).groupBy("id").agg(F.min_by(F.struct(*rest), "updated_at").alias("row")).select("id", "row.*")
    return rc.difference(rt.current(s), old, "id", ["key", "weight_kg", "gpu", "note"]).select("id", "status")


@register(f"WITH {_CONTEXTS}, {_EVIDENCE}, kept AS (SELECT id FROM ctx WHERE length(body) >= 300) SELECT id, context_id FROM evi WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.id = evi.context_id)")
def missing_children(spark, d):
    c = se.Corpus(spark, d)
    return rc.missing_children(c.evidence, c.contexts.filter("char_length(body) >= 300"), "context_id").select("id", "context_id")


@register(f"WITH {_SOURCES}, listed AS (SELECT id FROM src WHERE source_url IS NOT NULL), rep AS (SELECT id, CASE WHEN source_date IS NULL THEN 'skipped' WHEN document_schema = 'tool_card' THEN 'unregistered' ELSE 'processed' END AS status FROM src) SELECT src.id, CASE WHEN listed.id IS NULL THEN 'absent' ELSE rep.status END AS reason FROM src LEFT JOIN listed USING (id) LEFT JOIN rep USING (id) WHERE listed.id IS NULL OR rep.status IN ('skipped', 'unregistered')")
def stale_sources(spark, d):
    s = se.Corpus(spark, d).sources
    report = s.select("id", F.when(F.col("source_date").isNull(), "skipped").when(F.col("document_schema") == "tool_card", "unregistered").otherwise("processed").alias("status"))
    return rc.stale(s, s.filter("source_url IS NOT NULL").select("id"), report, "id")


@register(f"WITH {_SOURCES}, {_CONTEXTS}, {_EVIDENCE} SELECT src.id AS source_id, CAST(count(DISTINCT ctx.id) AS BIGINT) AS contexts, CAST(count(evi.id) AS BIGINT) AS evidence FROM src LEFT JOIN ctx ON ctx.source_id = src.id LEFT JOIN evi ON evi.context_id = ctx.id GROUP BY src.id")
def delete_preview(spark, d):
    c = se.Corpus(spark, d)
    return rc.cascade_counts(c.sources, c.contexts, c.evidence)


RULES = ((("mp",), "article"), (("mp", "c1"), "featured"), (("doc",), "document"), (("note",), "note"), (("note", "1"), "first note"))


@register(f"WITH {_SOURCES}, r(prefix, category) AS (VALUES " + ", ".join(f"('{':'.join(p)}', '{c}')" for p, c in RULES) + ") SELECT src.id, (SELECT max_by(category, length(prefix)) FROM r WHERE starts_with(src.canonical_locator || ':', prefix || ':')) AS category FROM src")
def classify_by_prefix(spark, d):
    rules = spark.createDataFrame([(list(p), c) for p, c in RULES], "prefix array<string>, category string")
    return rc.longest_prefix(se.Corpus(spark, d).sources, F.split("canonical_locator", ":"), rules, "id")


_STATUS = "CASE WHEN text IS NULL THEN 'failed' WHEN trim(text) = '' THEN 'skipped' WHEN lang IS NULL THEN 'unregistered' ELSE 'processed' END"


@register(f"SELECT document_schema, CAST(count_if(s = 'failed') AS BIGINT) AS failed, CAST(count_if(s = 'skipped') AS BIGINT) AS skipped, CAST(count_if(s = 'unregistered') AS BIGINT) AS unregistered, CAST(count_if(s = 'processed') AS BIGINT) AS processed FROM (SELECT document_schema, {_STATUS} AS s FROM documents) GROUP BY document_schema")
def import_summary(spark, d):
    """Ordered routing of every document to one status, counted per schema with all statuses as columns."""
    docs = table(spark, d, "documents")
    status = F.when(F.col("text").isNull(), "failed").when(F.trim("text") == "", "skipped").when(F.col("lang").isNull(), "unregistered").otherwise("processed")
    return docs.withColumn("s", status).groupBy("document_schema").pivot("s", ["failed", "skipped", "unregistered", "processed"]).count().fillna(0)


@register("SELECT id, CAST(count(*) AS BIGINT) AS rows FROM knowledge_source GROUP BY id HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rc.duplicate_keys(table(spark, d, "knowledge_source"), ["id"])


@register(f"WITH {_SOURCES}, {_CONTEXTS}, {_EVIDENCE} SELECT 'context.source' AS rule, CAST(count(*) AS BIGINT) AS broken FROM ctx WHERE source_id NOT IN (SELECT id FROM src) UNION ALL SELECT 'evidence.context', CAST(count(*) AS BIGINT) FROM evi WHERE context_id NOT IN (SELECT id FROM ctx) UNION ALL SELECT 'context.key', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM ctx GROUP BY source_id, key HAVING count(*) > 1) UNION ALL SELECT 'evidence.key', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM evi GROUP BY context_id, key HAVING count(*) > 1)")
def constraint_checks(spark, d):
    c = se.Corpus(spark, d)
    one = lambda rule, df, what: df.agg(what.alias("broken")).select(F.lit(rule).alias("rule"), F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))
    return rc.union_all([
        one("context.source", rc.orphans(c.contexts, "source_id", c.sources), F.sum("rows")), one("evidence.context", rc.orphans(c.evidence, "context_id", c.contexts), F.sum("rows")),
        one("context.key", rc.duplicate_keys(c.contexts, ["source_id", "key"]), F.count("*")), one("evidence.key", rc.duplicate_keys(c.evidence, ["context_id", "key"]), F.count("*")),
    ])


@register("SELECT doc_id, list_sort(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'text' END, CASE WHEN contains(coalesce(text, ''), chr(0)) THEN 'nul' END, CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 'n_chars' END, CASE WHEN lang IS NULL OR lang NOT IN ('zh', 'en') THEN 'lang' END, CASE WHEN source IS NULL THEN 'source' END], lambda x: x IS NOT NULL)) AS broken FROM documents")
def document_validator(spark, d):
    rules = {"text": F.col("text").isNotNull() & (F.trim("text") != ""), "nul": ~F.contains(F.coalesce("text", F.lit("")), F.lit("\0")), "n_chars": F.col("n_chars").eqNullSafe(F.length("text").cast("long")), "lang": F.col("lang").isin("zh", "en"), "source": F.col("source").isNotNull()}
    return table(spark, d, "documents").select("doc_id", rc.broken_rules(rules).alias("broken"))


@register(f"WITH {_SPECS} SELECT id, list_sort(list_filter([CASE WHEN weight_kg NOT BETWEEN 0.1 AND 10 THEN 'weight' END, CASE WHEN screen_inch NOT BETWEEN 5 AND 30 THEN 'screen' END, CASE WHEN battery_hours NOT BETWEEN 0 AND 48 THEN 'battery' END, CASE WHEN gpu IS NOT NULL AND has_dgpu IS NOT TRUE THEN 'gpu' END, CASE WHEN price_kind IS NOT NULL AND price_cny IS NULL THEN 'kind' END], lambda x: x IS NOT NULL)) AS broken FROM spec")
def spec_validator(spark, d):
    within = lambda c, a, b: F.coalesce(F.col(c).between(a, b), F.lit(True))
    rules = {"weight": within("weight_kg", 0.1, 10), "screen": within("screen_inch", 5, 30), "battery": within("battery_hours", 0, 48), "gpu": F.col("gpu").isNull() | F.coalesce("has_dgpu", F.lit(False)), "kind": F.col("price_kind").isNull() | F.col("price_cny").isNotNull()}
    return se.Corpus(spark, d).specs.select("id", rc.broken_rules(rules).alias("broken"))


@register("SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies, sha256(coalesce('=' || document_schema, '~') || chr(31) || coalesce('=' || text, '~')) AS digest FROM documents GROUP BY digest HAVING count(*) > 1")
def content_hash_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("document_schema"), F.col("text")).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").select("doc_id", "copies", "digest")


# ---- scalar functions ---------------------------------------------------------------------------------------------------------


@register(f"WITH {_SOURCES}, t AS (SELECT id, regexp_replace(trim(title), '^(?:【[^】]*】|\\s)+', '') AS body FROM src) SELECT id, rtrim(CASE WHEN regexp_matches(body, '^[^|｜]{{0,20}}[|｜]') THEN regexp_replace(body, '^[^|｜]*[|｜]\\s*', '') ELSE body END, ' ' || chr(9) || chr(10) || chr(13) || '　⭐') AS clean FROM t")
def title_clean(spark, d):
    return se.Corpus(spark, d).sources.select("id", tx.clean_title(F.col("title")).alias("clean"))


@register("SELECT article_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN lower(regexp_extract(url, '^https?://([^/?#]+)([^?#]*)', 1)) || ':' || regexp_replace(regexp_extract(url, '^https?://([^/?#]+)([^?#]*)', 2), '/+$', '') END AS identity, CAST(row_number() OVER (PARTITION BY url ORDER BY fetched_at, article_id) AS BIGINT) AS fetch FROM article")
def url_identity(spark, d):
    from pyspark.sql import Window

    fetch = F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "article_id")).cast("long").alias("fetch")
    return table(spark, d, "article").select("article_id", tx.url_identity(F.col("url")).alias("identity"), fetch)


@register(f"WITH {_SPECS} SELECT CASE WHEN regexp_matches(c, '^[RG]TX[0-9]+(TI)?$') THEN regexp_replace(c, '^([RG]TX)([0-9]+)(?:TI)?$', '\\1 \\2') || CASE WHEN c LIKE '%TI' THEN 'Ti' ELSE '' END ELSE trim(regexp_replace(gpu, '\\s+', ' ', 'g')) END AS gpu_name, CAST(count(*) AS BIGINT) AS rows FROM (SELECT gpu, regexp_replace(upper(gpu), '\\s+', '', 'g') AS c FROM spec) GROUP BY gpu_name")
def gpu_names(spark, d):
    return se.Corpus(spark, d).specs.groupBy(tx.gpu_name(F.col("gpu")).alias("gpu_name")).agg(F.count("*").alias("rows"))


@register("SELECT article_id, CASE WHEN url IS NULL THEN 'capture:' || article_id WHEN regexp_matches(url, '^https?://mp[.][^/]+/s/[A-Za-z0-9_-]+([?#].*)?$') THEN 'mp:s:' || regexp_extract(url, '/s/([A-Za-z0-9_-]+)', 1) END AS identity FROM article")
def article_identity(spark, d):
    """Stable identities of the fetched links; permanent links with query keys are in the tests."""
    return table(spark, d, "article").select("article_id", tx.article_identity(F.col("url"), F.col("article_id").cast("string"), r"^mp\.").alias("identity"))


@register("SELECT article_id, CAST(CAST(fetched_at + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS fetched_on, CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS stated FROM article")
def local_dates(spark, d):
    stated = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    return table(spark, d, "article").select("article_id", F.to_date(F.from_utc_timestamp("fetched_at", "Asia/Shanghai")).cast("string").alias("fetched_on"), stated.alias("stated"))


@register(f"WITH {_CONTEXTS}, {_EVIDENCE} SELECT evi.id, CAST(octet_length(encode(ctx.title || chr(10) || evi.body)) AS BIGINT) AS bytes, octet_length(encode(ctx.title || chr(10) || evi.body)) <= 2400 AS fits FROM evi JOIN ctx ON ctx.id = evi.context_id")
def byte_budget(spark, d):
    c = se.Corpus(spark, d)
    j = c.evidence.select("id", "context_id", "body").join(c.contexts.select(F.col("id").alias("context_id"), "title"), "context_id")
    size = F.octet_length(tx.retrieval_text(F.col("title"), F.lit(""), F.col("body"))).cast("long")
    return j.select("id", size.alias("bytes"), (size <= 2400).alias("fits"))


@register(f"WITH {_CONTEXTS} SELECT id, CASE WHEN n > 1 THEN k || '-' || n ELSE k END AS hashed FROM (SELECT id, 's-' || substr(sha256(title), 1, 16) AS k, row_number() OVER (PARTITION BY source_id, title ORDER BY ordinal, id) AS n FROM ctx)")
def hashed_keys(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source_id", "title").orderBy("ordinal", "id"))
    return se.Corpus(spark, d).contexts.select("id", "title", n.alias("n")).select("id", tx.hashed_key("s", F.col("title"), F.col("n")).alias("hashed"))


@register(f"WITH {_CONTEXTS} SELECT id, CASE WHEN length(body) > 200 THEN left(body, 99) || '…' || right(body, 100) ELSE body END AS short FROM ctx")
def shortened(spark, d):
    return se.Corpus(spark, d).contexts.select("id", tx.shorten(F.col("body")).alias("short"))


@register(f"WITH {_CONTEXTS}, p AS (SELECT id, list_transform(string_split(title, '>'), lambda x: regexp_replace(x, '^ +| +$', '', 'g')) AS path FROM ctx), n AS (SELECT DISTINCT unnest(list_transform(range(1, len(path) + 1), lambda i: path[1:i])) AS node FROM p) SELECT array_to_string(node, ' > ') AS node, CASE WHEN len(node) > 1 THEN array_to_string(node[1:len(node) - 1], ' > ') END AS parent, CAST(len(node) AS BIGINT) AS depth FROM n")
def ancestor_paths(spark, d):
    """Every node of the title hierarchy with its parent and depth."""
    path = F.transform(F.split("title", ">"), lambda x: F.regexp_replace(x, "^ +| +$", ""))
    nodes = se.Corpus(spark, d).contexts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))).alias("n")).distinct()
    join = lambda a: F.array_join(a, " > ")
    return nodes.select(join(F.col("n")).alias("node"), F.when(F.size("n") > 1, join(F.slice("n", F.lit(1), F.size("n") - 1))).alias("parent"), F.size("n").cast("long").alias("depth"))


# ---- lines, blocks, sections --------------------------------------------------------------------------------------------------


@register(f"WITH {_LINES} SELECT doc_id, CAST(s AS BIGINT) AS section, min_by(CASE WHEN regexp_matches(line, '^#{{1,2}} ') THEN trim(regexp_replace(line, '^#{{1,6}} ', '')) END, line_no) AS title, CAST(min(line_no) AS BIGINT) AS first_line, CAST(max(line_no) AS BIGINT) AS last_line FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,2}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM ln) GROUP BY doc_id, s")
def heading_sections(spark, d):
    return st.sections(st.text_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@register(f"WITH {_LINES} SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first_line, CAST(max(line_no) AS BIGINT) AS last_line, CAST(count(*) AS BIGINT) AS rows FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM ln WHERE NOT regexp_matches(line, '^#{{1,6}} ') AND regexp_matches(line, '^\\s*\\|.*\\|\\s*$')) GROUP BY doc_id, g")
def table_islands(spark, d):
    return st.islands(st.text_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "table")


@register(f"WITH {_LINES}, sec AS (SELECT doc_id, s AS section, min(line_no) AS a, max(line_no) AS b FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,2}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM ln) GROUP BY doc_id, s) SELECT ln.doc_id, CAST(ln.line_no AS BIGINT) AS line_no, CAST(sec.section AS BIGINT) AS section FROM ln JOIN sec ON sec.doc_id = ln.doc_id AND ln.line_no BETWEEN sec.a AND sec.b WHERE regexp_matches(ln.line, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(ln.line, '^#{{1,6}} ')")
def rows_in_sections(spark, d):
    lines = st.text_lines(table(spark, d, "documents"), "doc_id", "text")
    points = lines.filter(st.line_kind() == "table").select("doc_id", "line_no")
    return st.containing(points, st.sections(lines, "doc_id").select("doc_id", "section", "first_line", "last_line"), "doc_id", "line_no").select("doc_id", "line_no", "section")


@register(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS BIGINT) AS occurrence FROM ln WHERE trim(line) <> ''")
def line_occurrences(spark, d):
    lines = st.text_lines(table(spark, d, "documents"), "doc_id", "text").filter(F.trim("line") != "")
    return st.occurrences(lines, "doc_id", "line", "line_no").select("doc_id", "line_no", "occurrence")


@register(None)
def html_blocks(spark, d):
    return st.html_blocks(table(spark, d, "article"), "article_id", "html")


@register(None)
def document_passages(spark, d):
    return st.passages(table(spark, d, "documents"), "doc_id", "text")


@register("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY hour, event_type")
def event_windows(spark, d):
    """Hourly windows; the streaming form of the same plan is streaming.windows."""
    from lodestone.streaming.windows import hourly

    return hourly(table(spark, d, "events"))


_FENCE = "regexp_matches(line, '^\\s*(?:```|~~~)')"
_KIND = "CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(line, '^\\s*(?:[-*•]|[0-9]+[.)]) ') THEN 'list' WHEN regexp_matches(line, '^> ?') THEN 'quote' WHEN trim(line, ' ') = '' THEN 'blank' ELSE 'text' END"


@register(
    f"WITH {_LINES}, f AS (SELECT *, {_FENCE} AS fence, sum(CASE WHEN {_FENCE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ln), t AS (SELECT *, CASE WHEN n % 2 = 1 OR fence THEN 'code' ELSE {_KIND} END AS kind FROM f), "
    "c AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM t), b AS (SELECT *, sum(CASE WHEN prev IS NULL OR kind <> prev OR kind = 'heading' OR (fence AND n % 2 = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM c) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) AS BIGINT) AS block, any_value(kind) AS kind, CAST(min(line_no) AS BIGINT) AS first_line, CAST(max(line_no) AS BIGINT) AS last_line FROM b WHERE kind <> 'blank' GROUP BY doc_id, b"
)
def markdown_blocks(spark, d):
    return st.markdown_blocks(st.text_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


_BLOCKS = (
    f"{_LINES}, f AS (SELECT *, {_FENCE} AS fence, sum(CASE WHEN {_FENCE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ln), t AS (SELECT *, CASE WHEN n % 2 = 1 OR fence THEN 'code' ELSE {_KIND} END AS kind FROM f), "
    "c AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM t), nb AS (SELECT *, sum(CASE WHEN prev IS NULL OR kind <> prev OR kind = 'heading' OR (fence AND n % 2 = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM c), "
    f"blk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) AS block, any_value(kind) AS kind, sum(CASE WHEN kind = 'heading' THEN 0 ELSE length(regexp_replace(line, '{ol.SPACE}+', '', 'g')) END) AS chars, "
    "min(CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^#+')) END) AS level, min(CASE WHEN kind = 'heading' THEN trim(regexp_replace(line, '^#{1,6}[ \t]+', ''), ' ') END) AS title FROM nb WHERE kind <> 'blank' GROUP BY doc_id, b)"
)


@register(
    f"""WITH RECURSIVE {_BLOCKS}, h AS (SELECT doc_id, block, level, title, (SELECT max(p.block) FROM blk p WHERE p.doc_id = o.doc_id AND p.level < o.level AND p.block < o.block) AS parent,
coalesce((SELECT min(p.block) FROM blk p WHERE p.doc_id = o.doc_id AND p.level <= o.level AND p.block > o.block), 1000000000) AS past, coalesce((SELECT min(p.block) FROM blk p WHERE p.doc_id = o.doc_id AND p.level IS NOT NULL AND p.block > o.block), 1000000000) AS next FROM blk o WHERE level IS NOT NULL),
tree AS (SELECT doc_id, block, 1 AS depth, title AS path FROM h WHERE parent IS NULL UNION ALL SELECT h.doc_id, h.block, tree.depth + 1, tree.path || ' > ' || h.title FROM h JOIN tree ON tree.doc_id = h.doc_id AND tree.block = h.parent)
SELECT doc_id, block, parent, CAST(depth AS BIGINT) AS depth, path, (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) FROM blk WHERE blk.doc_id = h.doc_id AND blk.block >= h.block AND blk.block < h.next) AS own, (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) FROM blk WHERE blk.doc_id = h.doc_id AND blk.block >= h.block AND blk.block < h.past) AS size FROM h JOIN tree USING (doc_id, block)"""
)
def section_tree(spark, d):
    return ol.section_tree(ol.block_texts(st.text_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id"), "doc_id")


def _planned(spark, d):
    """Blocks of all documents with their parents, by the profile of their schema; no profile means one parent without limits."""
    docs = table(spark, d, "documents")
    sizes = table(spark, d, "section_profile").withColumnRenamed("content_type", "document_schema")
    own = docs.select("doc_id", "document_schema").join(sizes, "document_schema", "left").withColumn("title", F.concat_ws(" ", "document_schema", "doc_id")).drop("document_schema", "table_rows_as_children")
    return ol.planned_blocks(ol.block_texts(st.text_lines(docs, "doc_id", "text"), "doc_id").join(own, "doc_id"), "doc_id")


@register(None)
def planned_parents(spark, d):
    return ol.parents(_planned(spark, d), "doc_id")


@register(None)
def section_children(spark, d):
    return ol.children(_planned(spark, d), "doc_id")


@register(None)
def article_parents(spark, d):
    """Parents of the pages, with the sizes of the knowledge profile; the account is the document's title."""
    pages = table(spark, d, "article")
    sizes = table(spark, d, "section_profile").filter("content_type = 'knowledge'").select("max_parent_chars", "min_parent_chars", "min_intro_chars", "chunk_target_chars", "chunk_min_chars").limit(1)
    own = pages.select("article_id", F.coalesce("account", F.lit("page")).alias("title")).crossJoin(F.broadcast(sizes))
    blocks = ol.merge_rows(st.html_blocks(pages, "article_id", "html").withColumnRenamed("ordinal", "block"), "article_id")
    return ol.parents(ol.planned_blocks(blocks.join(own, "article_id"), "article_id"), "article_id")


@register(None)
def budget_pieces(spark, d):
    """Contexts cut to the byte budget of an encoder's input."""
    return ol.budget_pieces(se.Corpus(spark, d).contexts, "id", "title", "body")


_TIME = "(?:首次开机|出差途中|系统更新后|过了一周|[Aa]t first boot|[Aa] week later|[Aa]fter the update)[^。.！!？?；;\\n]{0,20}"


@register(f"WITH {_CONTEXTS} SELECT id, regexp_extract(body, '{_TIME}') AS phrase FROM ctx WHERE regexp_matches(body, '{_TIME}')")
def time_phrases(spark, d):
    """The first time-bound phrase of each context."""
    c = se.Corpus(spark, d).contexts
    return c.filter(F.col("body").rlike(_TIME)).select("id", F.regexp_extract("body", f"({_TIME})", 1).alias("phrase"))


@register(f"WITH {_SOURCES}, {_CONTEXTS} SELECT ctx.id, array_to_string(list_filter([src.source_type, src.document_schema, src.title], lambda p: p NOT IN (SELECT unnest([ctx.title]))), ' > ') AS prefix, '[' || coalesce(strftime(src.source_date, '%Y-%m-%d'), 'no date') || '] ' || ctx.title AS notice FROM ctx JOIN src ON src.id = ctx.source_id".replace("p NOT IN (SELECT unnest([ctx.title]))", "p <> ctx.title"))
def retrieval_prefixes(spark, d):
    """The path parts that a context's own title does not repeat, and a dated notice."""
    c = se.Corpus(spark, d)
    j = c.contexts.select("id", "source_id", "title").join(c.sources.select(F.col("id").alias("source_id"), "source_type", "document_schema", F.col("title").alias("source_title"), "source_date"), "source_id")
    prefix = F.array_join(F.filter(F.array("source_type", "document_schema", "source_title"), lambda p: p != F.col("title")), " > ")
    notice = F.concat(F.lit("["), F.coalesce(F.date_format("source_date", "yyyy-MM-dd"), F.lit("no date")), F.lit("] "), F.col("title"))
    return j.select("id", prefix.alias("prefix"), notice.alias("notice"))


@register(_BASE + _BM25 + ", " + _COSINE + ", fused AS (SELECT query_id, id, round(sum(w / (20 + rank)), 8) AS score FROM (SELECT query_id, id, rank, 1.0::DOUBLE AS w FROM keyword UNION ALL SELECT query_id, id, rank, 1.5::DOUBLE FROM vector) GROUP BY query_id, id) SELECT query_id, id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 20")
def weighted_fusion(spark, d):
    _, by_route = se.routes(spark, d)
    return rt.top_k(rt.fuse(by_route, "id", 20, {"vector": 1.5}), "id", 20).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@register(
    _BASE + _BM25 + f""", spec AS (SELECT * FROM product_spec QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1), par AS (SELECT query_id, context_id, min(rank) AS rank FROM keyword JOIN evi USING (id) GROUP BY query_id, context_id),
hit AS (SELECT query_id, spec.id AS spec_id, min(par.rank) AS rank FROM par JOIN spec ON spec.review_context_id = par.context_id GROUP BY query_id, spec.id)
SELECT query_id, spec_id, CAST(place AS BIGINT) AS place, CAST(rank AS BIGINT) AS hit_rank FROM (SELECT q.query_id, spec.id AS spec_id, hit.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY hit.rank ASC NULLS LAST, price_date DESC NULLS LAST, spec.key || spec.id) AS place FROM q CROSS JOIN spec LEFT JOIN hit ON hit.query_id = q.query_id AND hit.spec_id = spec.id) WHERE place <= 10"""
)
def preference_ranking(spark, d):
    """Spec rows by the keyword hits of their reviews, then newest first: the ten first of each query."""
    from lodestone.operators.ranking import rank_by_preference

    corpus, by_route = se.routes(spark, d)
    specs = corpus.specs.select(F.col("id").alias("spec_id"), "review_context_id", "price_date", F.concat("key", F.col("id").cast("string")).alias("name"))
    parents = by_route["keyword"].join(corpus.evidence.select("id", "context_id"), "id").groupBy("query_id", "context_id").agg(F.min("rank").alias("rank"))
    hits = parents.join(specs.select("spec_id", F.col("review_context_id").alias("context_id")), "context_id").groupBy("query_id", "spec_id").agg(F.min("rank").alias("rank"))
    return rank_by_preference(se.known_item_queries(corpus, vectors=False), hits, specs, "spec_id", "price_date", "name", 10)
