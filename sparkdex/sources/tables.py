"""Corpora from Parquet tables: rows as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt to as many tasks; any other as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table: ids lang/source/<padded id>.txt, so that they sort as numbers within a directory."""
    rows = spread(table(spark, sf_dir, "documents"))
    folder = F.concat_ws("/", "lang", "source")
    path = F.concat(folder, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), DIGITS, "0"), F.lit(".txt"))
    fields = F.create_map(F.lit("kind"), F.lit("text"), F.lit("dir"), folder, F.lit("ext"), F.lit(".txt"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return rows.select(
        path.alias("doc_id"),
        path.alias("path"),
        F.lit("").alias("title"),
        F.lit("text").alias("kind"),
        F.lit("").alias("language"),
        F.coalesce("text", F.lit("")).alias("body"),
        fields.alias("fields"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
    )
