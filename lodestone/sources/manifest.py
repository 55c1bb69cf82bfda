"""The import manifest: which collections and documents to take, and as what."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.operators.reconcile import longest_prefix

VISIBILITIES = ("public", "internal")


_FOLDER = re.compile(r"(?!\s*$)(?!\.{1,2}$)[^/\\\x00]+")


def is_folder_name(name: str) -> bool:
    """One component of a path: not blank, no separator, neither the folder itself nor the one above."""
    return _FOLDER.fullmatch(name) is not None


@dataclass(frozen=True)
class Manifest:
    """collections: name -> visibility; path_rules: (path, category); docs: key -> settings (category, visibility, canonical, metadata)."""

    source_type: str
    collections: dict[str, str]
    path_rules: tuple[tuple[tuple[str, ...], str], ...] = ()
    docs: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        for name, visibility in self.collections.items():
            if not is_folder_name(name) or visibility not in VISIBILITIES:
                raise ValueError(f"collections.{name}")
        if len({p for p, _ in self.path_rules}) < len(self.path_rules):
            raise ValueError("path_rules: a path occurs twice")
        for key, doc in self.docs.items():
            if unknown := set(doc) - {"category", "visibility", "canonical", "metadata"}:
                raise ValueError(f"docs.{key}: unknown {sorted(unknown)}")
            if doc.get("visibility", VISIBILITIES[0]) not in VISIBILITIES or key.split("/")[0] not in self.collections:
                raise ValueError(f"docs.{key}")

    @classmethod
    def load(cls, path: str) -> "Manifest":
        with open(path, "rb") as file:
            raw = tomllib.load(file)
        return cls(raw["source_type"], {k: v["visibility"] for k, v in raw["collections"].items()}, tuple((tuple(r["path"]), r["category"]) for r in raw.get("path_rules", ())), raw.get("docs", {}))

    def classify(self, spark: SparkSession, items: DataFrame, key: str, path: Column) -> DataFrame:
        """(key, category, classified_by, visibility): the document's own entry, else the longest path rule, else none."""
        rules = spark.createDataFrame([(list(p), c) for p, c in self.path_rules], "prefix array<string>, category string")
        own = spark.createDataFrame([(k, d.get("category"), d.get("visibility")) for k, d in self.docs.items()], f"{key} string, own string, own_visibility string")
        books = spark.createDataFrame(list(self.collections.items()), "collection string, book_visibility string")
        out = longest_prefix(items, path, rules, key).withColumnRenamed("category", "by_rule").join(own, key, "left").withColumn("collection", F.split(key, "/")[0]).join(books, "collection", "left")
        by = F.when(F.col("own").isNotNull(), "document").when(F.col("by_rule").isNotNull(), "path")
        return out.select(key, F.coalesce("own", "by_rule").alias("category"), by.alias("classified_by"), F.coalesce("own_visibility", "book_visibility").alias("visibility"))


def route_status(read_error: Column, selected: Column, category: Column, known: tuple[str, ...], skip: str = "skip") -> Column:
    """failed, dropped, skipped, unregistered or processed; the first that holds, in this order."""
    return F.when(read_error.isNotNull(), "failed").when(~selected, "dropped").when(category == skip, "skipped").when(category.isNull(), "unregistered").when(~category.isin(*known), "skipped").otherwise("processed")
