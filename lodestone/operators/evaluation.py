"""Metrics of ranked results, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_relevant(ranked: DataFrame, judged: DataFrame, queries: DataFrame, item: str) -> DataFrame:
    """(query_id, rank): rank of the first relevant item, null where none is; every query has a row."""
    hits = ranked.join(judged.filter("grade > 0"), ["query_id", item], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(hits, "query_id", "left")


def hit_columns(rank: Column) -> list[Column]:
    """Hit@1, Hit@5 and MRR@10 of first ranks; null counts as a miss."""
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return [mean(F.when(rank <= 1, 1.0)).alias("hit1"), mean(F.when(rank <= 5, 1.0)).alias("hit5"), mean(F.when(rank <= 10, F.lit(1.0) / rank)).alias("mrr10")]


def graded(ranked: DataFrame, judged: DataFrame, item: str, k: int = 5, recall_k: int = 10) -> DataFrame:
    """(query_id, p, ndcg, recall): P@k over min(relevant, k), nDCG@k with gain 2^grade - 1, R@recall_k over min(relevant, recall_k).

    Only queries with judged items have rows; measures without a relevant item are null.
    """
    from pyspark.sql import Window

    ideal = judged.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), item)))
    gain = lambda grade, at: (F.pow(F.lit(2.0), grade) - 1) / F.log2(at + 1)
    best = ideal.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("idcg"))
    got = ranked.join(judged, ["query_id", item]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias("in_k"), F.count_if((F.col("rank") <= recall_k) & (F.col("grade") > 0)).alias("in_r")
    )
    j = best.join(got, "query_id", "left").fillna(0, ["dcg", "in_k", "in_r"])
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return j.select("query_id", ratio(F.col("in_k"), F.least(F.col("relevant"), F.lit(k))).alias("p"), ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"), ratio(F.col("in_r"), F.least(F.col("relevant"), F.lit(recall_k))).alias("recall"))


def failures(keyword: DataFrame, vector: DataFrame, hybrid: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, failure): recall where neither route has a relevant item, ranking where fusion puts it after ``limit``, else null."""
    j = keyword.withColumnRenamed("rank", "kr").join(vector.withColumnRenamed("rank", "vr"), "query_id").join(hybrid.withColumnRenamed("rank", "hr"), "query_id")
    return j.select("query_id", F.when(F.col("kr").isNull() & F.col("vr").isNull(), "recall").when(F.col("hr").isNull() | (F.col("hr") > limit), "ranking").alias("failure"))


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, base_rank, other_rank, change) of two runs' first ranks: better, worse or same; a miss is worse than any rank."""
    j = base.select("query_id", F.col("rank").alias("base_rank")).join(other.select("query_id", F.col("rank").alias("other_rank")), "query_id", "full_outer")
    return j.withColumn("change", change(F.col("base_rank"), F.col("other_rank")))


def change(base: Column, other: Column) -> Column:
    """From one rank to another: better, worse or same; a miss (null) is worse than any rank."""
    far = F.lit(2_147_483_647)
    a, b = F.coalesce(base, far), F.coalesce(other, far)
    return F.when(b < a, "better").when(b > a, "worse").otherwise("same")
