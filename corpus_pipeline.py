"""From raw documents to packed training sequences: five operators, one table after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import decontaminate, langid, packing, simhash, toxicity
from radiolake.llm.common import keep
from radiolake.llm.queries import query, table, tokenizer_file


def _rows(docs: DataFrame) -> DataFrame:
    """One struct per row that carries all columns through an operator as its id."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and texts without a letter: those are in no language."""
    trees = langid.train(docs.where(langid.learning_rows()))
    found = langid.predict(_rows(docs), trees, "row", "text")
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("id.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(_rows(docs), model, "row", "text")
    return found.where(F.col("score") < 0.5).select("id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays.

    Of rows that repeat this id the first stays; rows without an id come after those with one. Rows
    of one id whose texts are not alike are in groups of their own.
    """
    rows = keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                            F.monotonically_increasing_id().alias("at")), "numbered")
    key = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"),
                   "at")
    found = simhash.near_duplicates(rows.select(key.alias("key"), F.col("row.text").alias("text")),
                                    "key")
    first = found.where(F.col("id") == F.col("component")).select(F.col("id.at").alias("at"))
    return rows.join(first, "at", "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes benchmark passages out of the texts; what is little else than such goes."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 ids."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).withColumnRenamed(
        "id", "doc_id")


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("best_fit_packing", packed)]

ORACLE_SQL = None  # the stages learn, hash and encode: they are tested by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
