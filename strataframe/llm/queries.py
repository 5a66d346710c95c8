"""The pN_ queries of the text problems over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import packing, residue, tokenize
from strataframe.storage import materialize, table, workspace

#: tokens in a container
CAPACITY = 4096


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text", tokenize.vocabulary_path(spark))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, packing.Plan]:
    sized = tokenize.token_counts(table(spark, d, "documents"), "doc_id", "text", tokenize.vocabulary_path(spark))
    return packing.fill(materialize(sized, workspace(spark, "sizes")), "doc_id", CAPACITY)


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, or of every piece of one that is larger than a container."""
    return _packed(spark, d)[0]


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: (used, number of containers)."""
    packed, _ = _packed(spark, d)
    boxes = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("used"))
    return boxes.groupBy("used").agg(F.count("*").alias("containers"))


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """One row: how the plan was made, its containers, the least number any plan needs, and that of first-fit alone."""
    sized = tokenize.token_counts(table(spark, d, "documents"), "doc_id", "text", tokenize.vocabulary_path(spark))
    p = packing.plan(packing.histogram(packing.items_of(sized, "doc_id", CAPACITY)), CAPACITY)
    return spark.createDataFrame([(p.method, p.containers, int(p.least), p.first_fit, p.used)], "method string, containers long, least long, first_fit long, used long")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.detect(table(spark, d, "documents"), "doc_id", "text").where("residue").select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that stay."""
    return residue.clean(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id")


QUERIES = {f.__name__: f for f in (p8_ids, p9_packed, p9_fill, p9_plan, p10_found, p10_clean)}
ORACLES: dict[str, str] = {}
