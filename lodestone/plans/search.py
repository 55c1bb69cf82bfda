"""Hybrid search over the knowledge base: scope, keyword and vector routes, fusion, grouping to parents, reading."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions.text import expand_synonyms, search_terms
from lodestone.operators.retrieval import bm25, cosine_topk, current, fuse, group_parents, one_each, scoped_contexts, top_k, valid_vector, with_terms
from lodestone.sources.tables import arrow_rows, materialize, table


@dataclass(frozen=True)
class SearchConfig:
    """candidates: a route's length; rrf_k and weights: of the fusion; top_k: parents returned; width: of vectors; batch: passages that a task hands to Python at once."""

    candidates: int = 100
    rrf_k: int = 20
    keyword_weight: float = 1.0
    vector_weight: float = 1.0
    top_k: int = 5
    width: int = 64
    batch: int = 2000
    visibilities: tuple[str, ...] = ("public", "internal")


class Corpus:
    """The current rows of the four tables, without repetitions; stored: the ids of all rows of evidence, as they stand."""

    def __init__(self, spark: SparkSession, directory: str):
        read = lambda name: table(spark, directory, name)
        self.sources = current(read("knowledge_source"))
        self.contexts = one_each(read("context_unit"))
        self.evidence = one_each(read("evidence_unit"))
        self.stored = read("evidence_unit").select("id", "context_id")
        self.specs = current(read("product_spec"))


def known_item_queries(corpus: Corpus, width: int = 64, vectors: bool = True) -> DataFrame:
    """(query_id, text, and v if asked for): the sources whose id, its first eight hex digits as a number, is divisible by 20: title, and the vector of their first passage that has one."""
    asked = corpus.sources.filter(F.conv(F.substring("id", 1, 8), 16, 10).cast("long") % 20 == 0).select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    if not vectors:
        return asked
    own = corpus.contexts.select(F.col("id").alias("context_id"), F.col("source_id").alias("query_id")).join(asked.select("query_id"), "query_id", "left_semi")
    rows = corpus.evidence.select("id", "context_id", "embedding")
    # of all passages only ids go to the contexts; their vectors stay where they were made distinct (a range, as a second equality would move them)
    near = corpus.stored.withColumnRenamed("id", "own_id").join(own, "context_id").withColumnRenamed("context_id", "own_context").distinct()
    held = rows.join(near, (F.col("id") == F.col("own_id")) & F.col("context_id").between(F.col("own_context"), F.col("own_context")))
    first = held.filter(valid_vector(F.col("embedding"), width)).groupBy("query_id").agg(F.min_by("embedding", "id").alias("v"))
    return asked.join(first, "query_id", "left")


def keyword_route(corpus: Corpus, evidence: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, id, score, rank) of the best passages by BM25 over their bodies: texts are cut into terms once, passages are not shuffled before the ranking."""
    terms = with_terms(queries.select("query_id", "text"), "query_id", F.col("text")).filter("length > 0")
    docs = materialize(with_terms(evidence, "id", F.col("body")), "terms")
    return top_k(bm25(docs, terms, "id", k=config.candidates, digits=6), "id", config.candidates)


def expanded_keyword_route(keyed: DataFrame, queries: DataFrame, synonyms: Sequence[Sequence[str]], least: float = 0.0, k: int = 100) -> DataFrame:
    """(query_id, id, score, rank) by BM25 over retrieval texts: queries with synonyms, model names with their pieces, scores of ``least`` and more, ties by stable key.

    keyed: evidence in scope with its stable_key. A query without terms has no rows.
    """
    cut = lambda df, key, text: df.select(key, F.coalesce(search_terms(text), F.array().cast("array<string>")).alias("terms"))
    docs = materialize(cut(keyed, F.struct("stable_key", "id").alias("place"), F.col("retrieval_text")).withColumn("length", F.size("terms")), "terms")
    scored = bm25(docs, cut(queries, "query_id", expand_synonyms(F.col("text"), synonyms)), "place", k=k, digits=6).filter(F.col("score") >= least)
    return top_k(scored, "place", k).select("query_id", "place.id", "score", "rank")


def vector_route(evidence: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, id, score, rank) of the best passages by cosine. Vectors are written once: every task sends on the best of each query, and a table is read by fewer tasks than its shuffle has parts."""
    vectors = materialize(evidence.filter(valid_vector(F.col("embedding"), config.width)).select("id", F.col("embedding").alias("v")), "vectors")
    return top_k(cosine_topk(vectors, queries.filter("v IS NOT NULL").select("query_id", "v"), "id", config.candidates), "id", config.candidates)


def routes(spark: SparkSession, directory: str, config: SearchConfig = SearchConfig()) -> tuple[Corpus, dict[str, DataFrame]]:
    """Both routes over the visible passages, written once: fusion, grouping and metrics read them several times."""
    corpus = Corpus(spark, directory)
    seen = scoped_contexts(corpus.contexts, corpus.sources, config.visibilities).select(F.col("id").alias("context_id"))
    # only ids go to the contexts; bodies and vectors stay where they were made distinct (a range, as a second equality would move them)
    near = materialize(corpus.stored.join(seen, "context_id", "left_semi").select(F.col("id").alias("own_id"), F.col("context_id").alias("own_context")).distinct(), "scope")
    evidence = corpus.evidence.join(near, (F.col("id") == F.col("own_id")) & F.col("context_id").between(F.col("own_context"), F.col("own_context")), "left_semi")
    queries = materialize(known_item_queries(corpus, config.width), "queries")
    with arrow_rows(spark, config.batch):
        return corpus, {"keyword": materialize(keyword_route(corpus, evidence, queries, config), "keyword"), "vector": materialize(vector_route(evidence, queries, config), "vector")}


def hybrid_search(spark: SparkSession, directory: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, rank, context_id, score, hits, title): the best parents of every query, bodies and titles joined last."""
    corpus, by_route = routes(spark, directory, config)
    fused = fuse(by_route, "id", config.rrf_k, {"keyword": config.keyword_weight, "vector": config.vector_weight})
    parents = group_parents(fused, corpus.evidence, "id", "context_id", config.top_k)
    return parents.join(corpus.contexts.select(F.col("id").alias("context_id"), "title"), "context_id").select("query_id", F.col("rank").cast("long").alias("rank"), "context_id", "score", "hits", "title")
