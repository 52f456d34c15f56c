"""Queries of the subpackage, by the name under which the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import copies, defects, leakage, mapping, near_duplicates, normalize, packing, privacy, scans, split
from folioflow.runtime import table

PARTS = ["subject", "relation", "object"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(near_duplicates.text_chunks(table(spark, root, "chunks")))


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(near_duplicates.text_chunks(table(spark, root, "chunks")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.damage(table(spark, root, "chunks"))


def p2_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return scans.repaired(table(spark, root, "chunks"), whole=True).select("chunk_id", F.array_join("kinds", ",").alias("kinds"), "text")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return mapping.map_relations(table(spark, root, "kg_triples"), table(spark, root, "relation_types")).select("triple_id", "relation_id")


def p3_unmatched(spark: SparkSession, root: str) -> DataFrame:
    found = mapping.map_relations(table(spark, root, "kg_triples"), table(spark, root, "relation_types"))
    return found.where("relation_id = 0").groupBy("relation").agg(F.count("*").alias("triples"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return copies.copies(table(spark, root, "kg_triples"), PARTS, "triple_id").select("first_id", F.col("id").alias("triple_id"))


def p4_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return copies.collapse(table(spark, root, "kg_triples"), PARTS, "triple_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return normalize.inconsistent_values(normalize.text_values(table(spark, root, "chunks"), table(spark, root, "answers_for_ragas"))).select("field", "row_id", "pos")


def p5_normalized(spark: SparkSession, root: str) -> DataFrame:
    values = normalize.text_values(table(spark, root, "chunks"), table(spark, root, "answers_for_ragas"))
    return normalize.normalize_values(values, "value", keep=("field", "row_id", "pos")).select("field", "row_id", "pos", "normalized", "match_key")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return defects.defects(table(spark, root, "answers_for_ragas"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return split.oversized(table(spark, root, "chunks")).select("chunk_id", "field", "kind")


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split.pieces(table(spark, root, "chunks"))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return privacy.personal_data(table(spark, root, "documents")).select("doc_id", "kind", "found").distinct()


def p10_sanitised(spark: SparkSession, root: str) -> DataFrame:
    return privacy.sanitised(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_paragraphs, p3_found, p3_unmatched, p4_found, p4_collapsed, p5_found, p5_normalized, p6_found, p7_found, p7_pieces, p8_packed, p9_found, p9_spans, p10_found, p10_sanitised)
}
