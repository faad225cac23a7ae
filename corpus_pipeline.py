"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and rereads as the next one's docs. All but the last return the columns
of ``documents``. A decision about a doc_id holds for all its rows, but in the Jaccard join, which decides by text;
rows with a null doc_id can't be named by one and pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.llm.common import drop, free_shuffles, stored, table
from sparkdex.llm.decontaminate import decontaminate
from sparkdex.llm.jaccard import jaccard_groups
from sparkdex.llm.language import identify_languages
from sparkdex.llm.packing import pack_documents
from sparkdex.llm.secrets import redacted_text
from sparkdex.llm.tokens import tokenizer_path

#: A document whose largest share is smaller is of no language.
LEAST_SHARE = 0.3
ROW, GROUP = "__row_of_doc_id", "__group_of_row"


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of a share of LEAST_SHARE, go.

    Null and empty texts have no letter. A repeated doc_id goes with all its rows if one of them does.
    """
    gone = identify_languages(docs).where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE))
    return without(docs, gone)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8 or more, directly or not, the smallest doc_id stays.

    Where doc_ids repeat, each text of one is a document of its own: of a group, the smallest doc_id's first by text.
    Null and empty texts link with nothing and stay.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    if not ids.where("count > 1").limit(1).count():
        return without(docs, jaccard_groups(docs, n=5, percent=80).where("doc_id != component_id"))
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).withColumn(ROW, F.monotonically_increasing_id())
    own, _ = stored(own, "pipeline-rows")
    groups = jaccard_groups(own.select(F.col(ROW).alias("doc_id"), "text"), n=5, percent=80)
    groups = groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias(GROUP))
    first = own.select(ROW, "doc_id", "text").join(groups, ROW).groupBy(GROUP).agg(F.min(F.struct("doc_id", "text", ROW)).alias("first"))
    kept = own.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go: one whole item is contamination already.

    Null and empty texts hold none and stay. A repeated doc_id goes with all its rows if one of them does.
    """
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_items >= 1"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced; n_chars follows the text. No row goes; null and empty texts stay as they are."""
    out = docs.withColumn("text", redacted_text(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.length("text"), F.lit(0)) != F.coalesce(docs["n_chars"], F.lit(-1))
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull() & changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. Null and empty texts are the end id alone, and each row of a
    repeated doc_id is a document of its own."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_languages),
    ("jaccard", keep_first_of_group),
    ("decontaminate", remove_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL expresses none of the stages but in part; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop(spark, before)
        before = path
        free_shuffles(spark)
    return docs
