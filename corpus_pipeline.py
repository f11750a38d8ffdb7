"""From raw documents to packed training sequences: the stages, one after another.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
stage's documents, the last one the packed pieces. No stage can be expressed in SQL (trained trees,
SimHash and edit similarity, signatures, a tokenizer), so ``ORACLE_SQL`` is None. The tests hold the
line and near-duplicate stages against brute force, and ``run`` against its stages one by one.

Nulls, empty texts and repeated rows pass through every stage: a null or empty text is scored like
any other, has no lines, links with nothing, is mixed by its source and packed as its end token alone.
Extra columns are dropped by the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, shared_folder
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.minhash import keep_one_of_each
from quillspark.llm.mixing import mix_sources
from quillspark.llm.packing import pack_documents
from quillspark.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity, training_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model learns from the labels of those at hand."""
    model = fit_toxicity(docs, training_labels(spark, sf_dir))
    return score_toxicity(docs, model, score="_score").where(F.col("_score") < THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that has no word left, but had, goes."""
    kept = dedup_lines(docs)
    emptied = (F.size("removed_lines") > 0) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    changed = F.size("removed_lines") > 0
    return kept.where(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows with the smallest id, once per text; null ids stay."""
    return keep_one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to the sources' target shares; rows with equal ids get equal counts."""
    return mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every row, repeated ones each."""
    return pack_documents(docs)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what came before has been read for the last time
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
