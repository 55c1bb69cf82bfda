"""File sources and sinks: JSON documents, capture directories, snapshots, spec files. Schemas are fixed, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone.functions.text import article_identity
from lodestone.operators.reconcile import broken_rules
from lodestone.sources.tables import materialize

_CHILD = "struct<key: string, body: string, locator: string, metadata: string, warnings: array<string>, retrieval_prefix: string>"
_CONTEXT = f"struct<key: string, title: string, body: string, locator: string, metadata: string, warnings: array<string>, children: array<{_CHILD}>>"
#: A standard document: its source, and the document with contexts and their passages.
DOCUMENT = f"source struct<source_type: string, canonical_locator: string, source_url: string, visibility: string>, document struct<title: string, document_schema: string, schema_version: int, source_date: date, metadata: string, warnings: array<string>, contexts: array<{_CONTEXT}>>, _corrupt string"
CAPTURE = "title string, url string, date string, author string, account string, _corrupt string"
TOC = "type string, title string, uuid string, parent_uuid string, url string, doc_id long"
DOCS = "id long, slug string, title string, content_updated_at timestamp"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Standard documents, one JSON object per file or line; what does not parse has its text in _corrupt."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("allowNonNumericNumbers", False).json(path)


def accepted(documents: DataFrame, limits: tuple[int, int] = (100, 100)) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons): the rules of a standard document, checked as one array of broken rules."""
    d = F.col("document")
    names = lambda a, f: F.transform(a, lambda x: x[f])
    distinct = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False)) & ~F.contains(c, F.lit("\0"))
    rules: dict[str, Column] = {
        "json": F.col("_corrupt").isNull(),
        "title": filled(d["title"]),
        "locator": filled(F.col("source.canonical_locator")),
        "visibility": F.col("source.visibility").isin("public", "internal"),
        "contexts": F.size(d["contexts"]).between(1, limits[0]),
        "context keys": distinct(names(d["contexts"], "key")),
        "children": F.forall(d["contexts"], lambda c: F.size(c["children"]).between(1, limits[1]) & distinct(names(c["children"], "key"))),
        "passages": F.forall(d["contexts"], lambda c: F.forall(c["children"], lambda x: F.contains(c["body"], x["body"]))),
    }
    checked = documents.withColumn("broken", broken_rules(rules))
    return checked.filter(F.size("broken") == 0).drop("broken"), checked.filter(F.size("broken") > 0)


def tables_of(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, contexts, evidence) of accepted documents; ids are hashes of the natural keys, ordinals the array positions from 1."""
    s, d = F.col("source"), F.col("document")
    digest = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256)
    base = documents.withColumn("source_id", digest(s["source_type"], s["canonical_locator"]))
    sources = base.select(F.col("source_id").alias("id"), "source.*", d["title"].alias("title"), d["document_schema"].alias("document_schema"), d["schema_version"].alias("schema_version"), d["source_date"].alias("source_date"), F.sha2(F.to_json(F.struct("source", "document"), {"ignoreNullFields": "false"}), 256).alias("content_hash"))  # null and absent, empty and null differ
    contexts = base.select("source_id", F.posexplode(d["contexts"]).alias("p", "c")).withColumn("context_id", digest(F.col("source_id"), F.col("c.key")))
    evidence = contexts.select("context_id", F.col("c.title").alias("title"), F.posexplode("c.children").alias("p", "e"))
    text = F.concat_ws("\n", F.col("title"), F.nullif(F.col("e.retrieval_prefix"), F.lit("")), F.col("e.body"))
    return (
        sources,
        contexts.select(F.col("context_id").alias("id"), "source_id", F.col("c.key").alias("key"), (F.col("p") + 1).alias("ordinal"), F.col("c.title").alias("title"), F.col("c.body").alias("body")),
        evidence.select(digest(F.col("context_id"), F.col("e.key")).alias("id"), "context_id", F.col("e.key").alias("key"), (F.col("p") + 1).alias("ordinal"), F.col("e.body").alias("body"), text.alias("retrieval_text")),
    )


def read_raw(spark: SparkSession, path: str, glob: str = "*", most: int = 2 << 20) -> DataFrame:
    """(name, content, text, reason): raw files; reason is 'too large' above ``most`` bytes, 'not UTF-8' where decoding fails, else null. A BOM goes, line ends become \\n."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    text = F.regexp_replace(F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", ""), "\r\n|\r", "\n")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    reason = F.when(F.col("length") > most, "too large").when(~good, "not UTF-8")
    return raw.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("path"), "content", F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))


def read_captures(spark: SparkSession, path: str, host: str = r"^mp\.") -> DataFrame:
    """(item, html, title, url, date, author, account, identity, copies) of a capture directory: *.html files with *.json beside them.

    identity is that of article_identity(), or the link as it is where it has another form; copies counts the items of one identity: more
    than one means that the listing is ambiguous (see ambiguous()).
    """
    from pyspark.sql import Window

    item = F.regexp_replace("name", r"\.(html|json)$", "")
    pages = read_raw(spark, path, "*.html").select(item.alias("item"), F.col("text").alias("html"))
    notes = read_raw(spark, path, "*.json").select(item.alias("item"), F.from_json("text", CAPTURE, {"columnNameOfCorruptRecord": "_corrupt"}).alias("n")).select("item", "n.*")
    joined = pages.join(notes, "item", "left")
    joined = joined.withColumn("identity", F.coalesce(article_identity(F.col("url"), F.col("item"), host), F.col("url")))
    return joined.withColumn("copies", F.count("*").over(Window.partitionBy("identity")))


def ambiguous(captures: DataFrame) -> DataFrame:
    """(identity, items): links that several items of a listing stand for; a listing with any is not to be imported."""
    return captures.filter("copies > 1").groupBy("identity").agg(F.array_sort(F.collect_list("item")).alias("items"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, slug, title, updated_at, collection_path, text) of a book snapshot: toc.json, docs.json and <slug>.md.

    The path is that of the table-of-contents node with the document's id, else with its slug; ancestors are followed by rounds of
    joins on the parent until none is left or a node comes again.
    """
    wrap = lambda schema: f"data array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in schema.split(', '))}>>"
    toc = spark.read.schema(wrap(TOC)).option("multiLine", True).json(f"{path}/toc.json").select(F.inline("data"))
    docs = spark.read.schema(wrap(DOCS)).option("multiLine", True).json(f"{path}/docs.json").select(F.inline("data"))
    nodes = toc.select("uuid", F.nullif("parent_uuid", F.lit("")).alias("parent"), "title", "url", "doc_id")
    up = nodes.select(F.col("uuid").alias("parent"), F.col("parent").alias("next"), F.col("title").alias("above"))
    walk = nodes.select("uuid", "parent", "url", "doc_id", F.array().cast("array<string>").alias("collection_path"), F.array("uuid").alias("seen"))
    walk = materialize(walk, "toc")
    while not walk.filter("parent IS NOT NULL").isEmpty():
        step = walk.join(up, "parent", "left")
        again = F.array_contains("seen", F.col("parent"))
        walk = step.select("uuid", F.when(~F.coalesce(again, F.lit(False)), F.col("next")).alias("parent"), "url", "doc_id", F.when(F.col("above").isNotNull() & ~F.coalesce(again, F.lit(False)), F.concat(F.array("above"), F.col("collection_path"))).otherwise(F.col("collection_path")).alias("collection_path"), F.when(F.col("parent").isNotNull(), F.concat("seen", F.array("parent"))).otherwise(F.col("seen")).alias("seen"))
        walk = materialize(walk, "toc")  # each round reads the one before, not all of them
    by_id = walk.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("collection_path").alias("p1"))
    by_slug = walk.filter("url IS NOT NULL").groupBy(F.col("url").alias("slug")).agg(F.min("collection_path").alias("p2"))
    bodies = read_raw(spark, path, "*.md").select(F.regexp_replace("name", r"\.md$", "").alias("slug"), "text")
    out = docs.withColumnRenamed("id", "doc_id").join(by_id, "doc_id", "left").join(by_slug, "slug", "left").join(bodies, "slug", "left")
    return out.select("doc_id", "slug", "title", F.to_date(F.from_utc_timestamp("content_updated_at", "Asia/Shanghai")).alias("updated_on"), F.coalesce("p1", "p2", F.array().cast("array<string>")).alias("collection_path"), "text")


def write_snapshot(documents: DataFrame, path: str) -> None:
    """Writes (key, text) rows as text files, one folder per key hash; a rerun replaces the whole snapshot."""
    documents.select(F.pmod(F.xxhash64("key"), F.lit(64)).alias("bucket"), "key", "text").write.mode("overwrite").partitionBy("bucket").json(path)


def read_specs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Spec records from a JSON file; NaN and Infinity are not numbers here, such records come out as _corrupt."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", False).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def readable_specs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of read_specs() that could be read, and the texts of the others; its schema must have a string field _corrupt.

    A file that is one list of records is one text: an unreadable record keeps its whole file out.
    """
    return records.filter(F.col("_corrupt").isNull()).drop("_corrupt"), records.filter(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("record"))
