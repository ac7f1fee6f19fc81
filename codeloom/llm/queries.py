"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import credentials, docpairs, leakage, provenance, sentences, syntax, tokens
from codeloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(table(spark, d, "file_contents")).select("file_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every content with its credentials overwritten in place."""
    return credentials.redacted(table(spark, d, "file_contents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(table(spark, d, "files"), table(spark, d, "file_contents")).where("verdict <> 'ok'").select("file_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.verdicts(table(spark, d, "files"), table(spark, d, "file_contents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.labels(table(spark, d, "files"), table(spark, d, "file_contents")).where("label <> 'handwritten'").select("file_id").distinct()


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.labels(table(spark, d, "files"), table(spark, d, "file_contents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.found(table(spark, d, "symbols"), table(spark, d, "file_contents"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "symbols"), table(spark, d, "file_contents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them and the greatest share."""
    found = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("share").alias("most"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p3_found, p3_rates, p6_found, p6_labels, p7_found, p7_pairs, p8_ids, p9_found, p9_items, p10_found)
}
SQL: dict[str, str] = {}
