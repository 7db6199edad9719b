"""From raw documents to token ids: the stages in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import bpe, decontaminate, jaccard, langid, toxicity
from lotlens.llm.catalog import MULTI_RANKS, severity_grades
from lotlens.llm.common import table, written


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from `lang`; rejected go: no letter, or far from every language learned."""
    model = langid.train(docs)
    found = spare(docs, "_found")
    return docs.withColumn(found, langid.identify(docs, model)).where(f"not {found}.rejected").drop(found)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity under one half, by a model fitted on `labels`."""
    model = toxicity.train(docs, severity_grades(spark, sf_dir))
    found = spare(docs, "_found")
    return docs.withColumn(found, toxicity.grade(docs, model)).where(f"not {found}.toxic").drop(found)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 80 % similarity): that with the smallest doc_id.

    Of several rows with that doc_id the one with the smallest hash stays; rows without a doc_id come last. Rows are told
    apart by a 64-bit hash of doc_id and text, so rows equal in both are one.
    """
    row = F.xxhash64("doc_id", "text")
    found = jaccard.join(docs.select(row.alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("_row"), "component_id").dropDuplicates(["_row"])
    named = docs.select(row.alias("_row"), "doc_id").dropDuplicates(["_row"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    kept = found.join(named, "_row").groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    own = spare(docs, "_row")
    return docs.withColumn(own, row).join(kept.withColumnRenamed("_row", own), own, "left_semi").dropDuplicates([own]).drop(own)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`."""
    found = spare(docs, "_found")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), found).where(f"size({found}) = 0").drop(found)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of its ids and the digests of ids and decoded bytes."""
    return docs.select("doc_id", bpe.coded(F.col("text"), MULTI_RANKS).alias("c")).select("doc_id", "c.*")


STAGES = [("language ID", in_a_language), ("toxicity", not_toxic), ("n-gram Jaccard join", one_of_each_group),
          ("benchmark decontamination", decontaminated), ("byte-level BPE", tokenised)]

#: The stages run trained models and alignments, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # Whole texts pass through the writers; small row groups keep what an executor buffers small.
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), **{"parquet.block.size": 16 << 20})
    return STAGES[-1][1](spark, docs, sf_dir)
