"""Keyed upsert, snapshot difference, stale and missing rows, cascade deletes: joins that plan a rewrite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def upsert_plan(incoming: DataFrame, stored: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, action): created, updated, unchanged, or absent for stored keys that are not incoming."""
    a = incoming.select(*key, F.col(digest).alias("new"), F.lit(True).alias("in_new"))
    b = stored.select(*key, F.col(digest).alias("old"), F.lit(True).alias("in_old"))
    j = a.join(b, key, "full_outer")
    action = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "absent").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("updated")
    return j.select(*key, action.alias("action"))


def apply_upsert(incoming: DataFrame, stored: DataFrame, key: list[str], digest: str, keep_absent: bool = True) -> DataFrame:
    """The table after the upsert: unchanged rows stay as stored (with their ids), updated ones take the incoming values but keep ``id``.

    One full outer join carries both rows as structs; the row that counts is chosen in place.
    """
    columns = stored.columns
    a = incoming.select(*key, F.struct(*columns).alias("new"))
    b = stored.select(*key, F.struct(*columns).alias("old"))
    j = a.join(b, key, "full_outer")
    if not keep_absent:
        j = j.filter("new IS NOT NULL")
    stays = F.col("new").isNull() | F.col("old").isNotNull() & F.col(f"new.{digest}").eqNullSafe(F.col(f"old.{digest}"))
    picked = [F.when(stays, F.col(f"old.{c}")).otherwise(F.coalesce(f"old.{c}", f"new.{c}") if c == "id" and c not in key else F.col(f"new.{c}")).alias(c) for c in columns]
    return j.select(*picked)


def difference(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status, changed): created, updated (with the changed columns), unchanged, deleted; null equals null."""
    a = new.select(key, F.struct(*columns).alias("n"))
    b = old.select(key, F.struct(*columns).alias("o"))
    j = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in columns)))
    status = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return j.select(key, status.alias("status"), F.when(F.col("n").isNotNull() & F.col("o").isNotNull(), changed).alias("changed"))


def missing_children(children: DataFrame, kept_parents: DataFrame, parent_col: str) -> DataFrame:
    """Children whose parent is gone (null parents count as gone)."""
    return children.join(kept_parents.select(F.col("id").alias(parent_col)).distinct(), parent_col, "left_anti")


def stale(stored: DataFrame, listed: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """(key, reason): stored keys that the listing lacks (absent), or that the report skipped or left unregistered; a failed read is not stale."""
    j = stored.select(key).join(listed.select(key, F.lit(True).alias("there")), key, "left").join(report.select(key, "status"), key, "left")
    reason = F.when(F.col("there").isNull(), "absent").when(F.col("status").isin("skipped", "unregistered"), F.col("status"))
    return j.select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def cascade_counts(sources: DataFrame, contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, contexts, evidence): what deleting each source takes along."""
    c = contexts.select(F.col("id").alias("context_id"), "source_id").distinct()
    e = evidence.select("id", "context_id").distinct().groupBy("context_id").agg(F.count("*").alias("evidence"))
    per = c.join(e, "context_id", "left").groupBy("source_id").agg(F.count("*").alias("contexts"), F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence"))
    return sources.select(F.col("id").alias("source_id")).distinct().join(per, "source_id", "left").fillna(0, ["contexts", "evidence"])


def longest_prefix(items: DataFrame, path: Column, rules: DataFrame, key: str) -> DataFrame:
    """(key, category) by the longest rule prefix of the item's path (arrays of equal components), null for none.

    rules: (prefix array<string>, category). Every item path is cut into its prefixes, so the match is an equi-join on the prefix, not a
    product of items and rules.
    """
    cut = items.select(key, F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda i: F.slice(path, 1, i))).alias("prefix"))
    hit = cut.join(rules, "prefix").groupBy(key).agg(F.max_by("category", F.size("prefix")).alias("category"))
    return items.select(key).distinct().join(hit, key, "left")


def broken_rules(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that a row breaks; an unknown rule counts as broken."""
    return F.sort_array(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows) of the keys that occur more than once; null keys count."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """(column, rows): values without a parent, nulls left out."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)).distinct(), column, "left_anti").groupBy(column).agg(F.count("*").alias("rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def visible_links(specs: DataFrame, contexts: DataFrame, sources: DataFrame, visibilities: tuple[str, ...]) -> DataFrame:
    """(spec_id, key, context_id, source_title) of the specs whose review is visible."""
    seen = sources.filter(F.col("visibility").isin(*visibilities)).select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    reviews = contexts.select(F.col("id").alias("context_id"), "source_id").join(seen, "source_id")
    return specs.select(F.col("id").alias("spec_id"), "key", F.col("review_context_id").alias("context_id")).join(reviews, "context_id").select("spec_id", "key", "context_id", "source_title")


def link_by_title(df: DataFrame, id_col: str, name_col: str, targets: DataFrame, target_id: str, title_col: str) -> DataFrame:
    """(id_col, reviews, context_id, status): rows by the targets whose title is their name, white space apart: unlinked, linked or failed (several)."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    titled = targets.select(F.col(target_id).alias("target"), plain(title_col).alias("name")).groupBy("name").agg(F.count_distinct("target").alias("reviews"), F.min("target").alias("one"))
    j = df.select(id_col, plain(name_col).alias("name")).join(titled, "name", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    status = F.when(F.col("reviews") == 0, "unlinked").when(F.col("reviews") == 1, "linked").otherwise("failed")
    return j.select(id_col, "reviews", F.when(F.col("reviews") == 1, F.col("one")).alias("context_id"), status.alias("status"))


def all_or_nothing(df: DataFrame, group_col: str, failed: Column) -> DataFrame:
    """(group_col, rows, failed, imported): a group with any failed row imports none."""
    counted = df.groupBy(group_col).agg(F.count("*").alias("rows"), F.count_if(failed).alias("failed"))
    return counted.withColumn("imported", F.when(F.col("failed") > 0, F.lit(0)).otherwise(F.col("rows")).cast("long"))


def unchanged(incoming: DataFrame, stored: DataFrame, contexts: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows that agree with a stored one in all columns of ``key`` and whose stored row has contexts."""
    filled = stored.join(contexts.select(F.col("source_id").alias("id")), "id", "left_semi").select(*key)
    return incoming.join(filled.distinct(), key, "left_semi")
