"""Ranking of candidates by preference hits and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def rank_by_preference(queries: DataFrame, hits: DataFrame, candidates: DataFrame, item: str, date: str, key: str, k: int) -> DataFrame:
    """(query_id, item, place, hit_rank): hits in their order, then the other candidates newest first (no date last), ties by key; the k first.

    hits: (query_id, item, rank). Only the k newest candidates can fill up a query's places behind its hits, and at most k of them are
    hits themselves, so 2k rows (a bounded broadcast) stand for all candidates: queries and candidates are never multiplied.
    """
    newest = candidates.select(item, date, key).orderBy(F.desc_nulls_last(date), F.asc(key)).limit(2 * k)
    hit = hits.select("query_id", item, "rank").join(candidates.select(item, date, key), item)
    fill = queries.select("query_id").crossJoin(F.broadcast(newest)).join(hits.select("query_id", item), ["query_id", item], "left_anti")
    rows = hit.unionByName(fill.withColumn("rank", F.lit(None).cast("int")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last(date), F.asc(key)))
    return rows.select("query_id", item, place.cast("long").alias("place"), F.col("rank").cast("long").alias("hit_rank")).filter(F.col("place") <= k)
