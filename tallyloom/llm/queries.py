"""Queries p1, p3 and p8 to p10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import entities, leakage, mojibake, tokens, variants
from tallyloom.session import cut
from tallyloom.sources.tables import table


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity", "entity_id", "entity_type", "uscc", "id_card").select(
        "entity_id", variants.identity_key(F.col("uscc"), F.col("id_card")).alias("key"), (F.col("entity_type") == "natural_person").alias("person")
    )


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every match of an entity row and a ledger record with its confidence."""
    ledger = table(spark, d, "ledger_subject", "record_id", "ledger_name", "subject_name", "cert_text", "phone_text", "address_text", "rep_name")
    return entities.matched(ledger, table(spark, d, "entity_name", "name_id", "entity_id", "name"), _entities(spark, d), table(spark, d, "entity_profile", "entity_id", "field", "value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("entity_id", "record_id").distinct()


def _spelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "entity_name", "name_id", "entity_id", "name"), _entities(spark, d), table(spark, d, "entity_profile", "entity_id", "field", "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_spellings(*_spelled(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each linked name with its class of spellings and its number of links; copies aren't expanded into pairs."""
    return variants.class_sizes(cut(variants.name_classes(*_spelled(spark, d))))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return tokens.decoded(p8_ids(spark, d), "doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = mojibake.garbled(table(spark, d, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", F.when(F.col("lost"), "").otherwise(F.md5(F.encode("restored", "UTF-8"))).alias("restored_md5"))


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p3_found": p3_found, "p3_classes": p3_classes, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p10_found": p10_found}
SQL: dict[str, str] = {"p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
