"""The registered queries of this subpackage: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.bpe import decode_corpus, encode_corpus
from lodestone.llm.leakage import leaked, without_leaks
from lodestone.llm.lookalike import bigram_counts, fields, normalized
from lodestone.llm.neardup import NearDupConfig, duplicate_pairs, duplicate_summary, near_duplicates
from lodestone.llm.pii import pii_mentions, redacted
from lodestone.llm.split import split_items, with_limits
from lodestone.llm.vectors import VectorConfig, nearest_vectors
from lodestone.llm.webpage import main_blocks, rendered
from lodestone.sources.tables import table

BODIES = NearDupConfig(n=5, min_chars=40, threshold=0.6)
TITLES = NearDupConfig(n=2, min_chars=10, threshold=0.6, slack=0.03, least_fragments=4)


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    out = []
    for kind, name, column, config in (("context", "context_unit", "body", BODIES), ("source", "knowledge_source", "title", TITLES)):
        pairs = duplicate_pairs(*near_duplicates(table(spark, directory, name), "id", column, config))
        out.append(pairs.select(F.lit(kind).alias("record_kind"), "id_a", "id_b"))
    return out[0].unionByName(out[1])


def p1_classes(spark: SparkSession, directory: str) -> DataFrame:
    """One row per record: its class of equal texts, the copies in it and its links to other texts; no class is expanded into pairs."""
    out = []
    for kind, name, column, config in (("context", "context_unit", "body", BODIES), ("source", "knowledge_source", "title", TITLES)):
        out.append(duplicate_summary(*near_duplicates(table(spark, directory, name), "id", column, config)).select(F.lit(kind).alias("record_kind"), "id", "class_id", "copies", "links"))
    return out[0].unionByName(out[1])


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    near = nearest_vectors(table(spark, directory, "evidence_unit"), "id", "embedding", VectorConfig(k=10, floor=0.9))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """Ten neighbours, however far, of a twentieth of the ids (by their checksum), searched in all rows."""
    evidence = table(spark, directory, "evidence_unit")
    near = nearest_vectors(evidence, "id", "embedding", VectorConfig(k=10, probes=16), F.crc32(F.col("id").cast("binary")) % 20 == 0)
    return near.select("id", "neighbour", F.round("cosine", 4).alias("cosine"), "rank")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return main_blocks(table(spark, directory, "article")).select("article_id", "block_md5").distinct()


def p3_rendered(spark: SparkSession, directory: str) -> DataFrame:
    return rendered(table(spark, directory, "article"))


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    items = with_limits(*(table(spark, directory, t) for t in ("context_unit", "evidence_unit", "knowledge_source", "section_profile")))
    return split_items(items, ["record_kind", "record_id"], "body", "target", "overlap")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return p4_pieces(spark, directory).filter("piece_no = 1").select("record_kind", "record_id")


def p5_normalized(spark: SparkSession, directory: str) -> DataFrame:
    values = fields(table(spark, directory, "context_unit"), table(spark, directory, "product_spec"))
    return normalized(values, "value", bigram_counts(values, "value")).drop("value").distinct()


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    values = fields(table(spark, directory, "context_unit"), table(spark, directory, "product_spec"))
    changed = normalized(values, "value", bigram_counts(values, "value"), suspects_only=True).filter("size(disguises) > 0")
    return changed.select("record_kind", "record_id", "field_name").distinct()


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_corpus(table(spark, directory, "documents"))


def p6_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """The texts of the documents back from their ids; null texts come back empty."""
    return decode_corpus(encode_corpus(table(spark, directory, "documents")))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaked(table(spark, directory, "documents"), table(spark, directory, "eval_item")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return without_leaks(documents, leaked(documents, table(spark, directory, "eval_item"))).select("doc_id", "text")


def _pii_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: the session's, else one of this run alone."""
    given = spark.conf.get("spark.lodestone.pseudonym.key", None)
    return hashlib.blake2b(given.encode(), digest_size=32).digest() if given else secrets.token_bytes(32)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return pii_mentions(table(spark, directory, "documents"), _pii_key(spark)).select("doc_id", "pii_type", "pii_text")


def p8_redacted(spark: SparkSession, directory: str) -> DataFrame:
    return redacted(table(spark, directory, "documents"), _pii_key(spark))


def queries() -> dict:
    found = (p1_found, p1_classes, p2_found, p2_neighbours, p3_found, p3_rendered, p4_found, p4_pieces, p5_found, p5_normalized, p6_ids, p6_decoded, p7_found, p7_clean, p8_found, p8_redacted)
    return {f.__name__: f for f in found}


_LATEST = "src AS (SELECT id, document_schema FROM knowledge_source QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1), lim AS (SELECT DISTINCT c.id, c.body, p.chunk_target_chars AS target FROM context_unit c JOIN src ON src.id = c.source_id JOIN section_profile p ON p.content_type = src.document_schema)"


def oracle_sql() -> dict[str, str]:
    """SQL with the same result, where there is any. p2_found compares with exact search: its lists lose nothing on the small tables."""
    valid = "len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
    return {
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p4_found": f"WITH {_LATEST} SELECT 'context' AS record_kind, id AS record_id FROM lim WHERE length(body) > target UNION SELECT 'evidence', e.id FROM evidence_unit e JOIN lim ON lim.id = e.context_id WHERE length(e.body) > target",
        "p2_found": f"""WITH v AS (SELECT DISTINCT ON (id) id, embedding AS e FROM evidence_unit WHERE {valid} ORDER BY id), s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t WHERE c >= 0.9""",
    }
