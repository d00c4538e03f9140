"""A pipeline of five stages over the documents: quality rules, line dedup, near-copy dedup, benchmark decontamination, packing.

Each stage works on what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents, with
their types and whatever their names. In all stages a null text counts as empty, rows are judged by their texts and not by their ids
(null and repeated ones too), very long texts are worked on whole, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import WORD, cut, ensure_checkpoint_dir, named, read_table, with_columns_of
from lodestone.llm.decontamination import uncontaminated
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.near_copies import near_copy_components
from lodestone.llm.packing import VOCABULARY, pack
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.tokens import vocabulary
from lodestone.sources.storage import removed


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they stand; null and empty texts have too few words and go. Repeated rows are judged each."""
    return with_columns_of(quality_rules(docs, carry=True).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their near-duplicate lines (``n_chars`` follows, if there); one that loses lines and keeps no word goes.

    The earliest line by doc_id and number stays, rows without an id come last; lines of one id and number are equally early and both stay.
    """
    left = line_dedup(docs, carry=True).where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    out = with_columns_of(left, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, ids before none, then by hashes of text and other columns.

    Texts link at 0.8 of their 5-word shingles or by SimHash, whatever the ids of their rows; rows that share an id and aren't near
    copies all stay. Of rows that are the same in all columns one stays. A null text is empty, and empty texts are copies of each other.
    """
    others = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("id"), (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")).alias("rest"))
    found = near_copy_components(docs.select(row["key"].alias("key"), text.alias("text")))
    same = docs.select(row.alias("row")).select("row.*").groupBy("key", "id", "rest").agg(F.count(F.lit(1)).alias("n"))
    order = lambda *more: F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "rest", "n", *more)).alias("least")
    texts = same.groupBy("key").agg(order())
    grouped = texts.join(found, texts["key"] == found["node"], "left").groupBy(F.coalesce("component", "key").alias("group")).agg(F.min("least").alias("least"))
    kept = cut(grouped.select(*[F.col("least")[c].alias(f"_{c}") for c in ("key", "id", "rest", "n")]))
    names = docs.columns
    rows = docs.select(row.alias("row"), *[named(c).alias(f"c{k}") for k, c in enumerate(names)])
    at = (F.col("row.key") == F.col("_key")) & F.col("row.id").eqNullSafe(F.col("_id")) & (F.col("row.rest") == F.col("_rest"))
    chosen = rows.join(kept, at)
    if not kept.where("_n > 1").isEmpty():  # some rows are the same in all columns
        chosen = chosen.where("_n = 1").unionByName(chosen.where("_n > 1").dropDuplicates(["_key", "_id", "_rest"]))
    return chosen.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as they stand; all of them if the benchmark is empty. Repeated rows are judged each."""
    return uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; repeated rows are packed each."""
    return pack(docs, vocabulary(VOCABULARY))


STAGES = [("quality rules", rules), ("line dedup", lines), ("near copies", near_copies), ("decontamination", leaks), ("packing", packed)]
#: Stages tokenize, hash and pack, which SQL can't express; tests/llm/test_pipeline.py holds each against SQL or plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage read isn't needed any more
            removed(spark, f"{folder}/{k - 1}")
    return docs
