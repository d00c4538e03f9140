"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_texts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text counts as empty. Other columns are left behind, or go along in the struct ``_row``."""
    others = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    row = [F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("_row")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row)


def with_columns_of(carried: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, doc_id and text as they are now."""
    return carried.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])


def with_id(texts: DataFrame) -> DataFrame:
    """Adds ``id``, 0 where doc_id is null, and ``none``, whether it is: keys that joins and orders can take."""
    return texts.withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "none": F.col("doc_id").isNull()})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's digits, modulo n (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bind(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a temporary one if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def redealt(few: DataFrame) -> DataFrame:
    """The smaller side of a join by a key that many rows of the other may share, dealt anew: so the join deals both sides itself, and
    Spark may split the rows of such a key over several tasks, which it can't where one side lies by key already."""
    return few.repartition(partitions(few.sparkSession))


#: Slots of a sieve, 64 to a row of what is sent to all machines: a megabyte, whatever goes in.
SIEVE_SLOTS = 1 << 22


def sieved(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with ``_hit``: true where the hash in column is one of keys (one column of hashes, no nulls), and for few others.

    It spares a join rows that have no partner; the join itself still decides. With more keys than slots most others are hit too.
    """
    slot = lambda x: F.pmod(F.col(x), F.lit(SIEVE_SLOTS))
    bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    bits = keys.select(slot(keys.columns[0]).alias("_slot")).select(F.shiftright("_slot", 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    told = df.withColumn("_slot", slot(column)).withColumns({"_at": F.shiftright("_slot", 6), "_bit": bit})
    told = told.join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return told.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).select(*df.columns, "_hit")


def give_back() -> None:
    """Returns what this worker has freed to the system, as it lives on beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc: nothing to trim
        pass
