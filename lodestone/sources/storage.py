"""Where intermediate and cold tables go."""

from __future__ import annotations

import tempfile

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a temporary one if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df behind a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> tuple[DataFrame, int]:
    """df with each row's place in the order, and the rows: ranges are sorted apart, and only their sizes reach the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = {}, 0
    for p, size in sizes:
        bases[p], total = total, total + size
    if not bases:
        return df.withColumn(name, F.lit(0).cast("long")), 0
    base = F.create_map(*[x for p, b in bases.items() for x in (F.lit(p), F.lit(b).cast("long"))])
    return placed.withColumn(name, F.element_at(base, part) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), total


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
