"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. The rows of
one stage are written as Parquet and read again as the next one's ``docs``; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontam, packing, quality, simhash
from folio.llm.common import col, fresh, shared_folder, table
from folio.llm.line_dedup import LineIndex
from folio.session import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the classifier's cut go; it learns from the ``labels`` of ``docs``.

    A null or empty text is scored like any other; repeated rows and ties score alike and go or stay together. Without labels of both
    kinds nothing goes; an empty table stays empty. All columns are kept as they are."""
    ship_package(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document has too go from the texts; ``n_chars`` follows where a text changed.
    A document that loses all lines stays, with an empty text. A null text stays null; a null id is the largest; rows that repeat
    an id are one document and keep the same lines; an empty table stays empty. Further columns are kept as they are."""
    ship_package(spark)
    lines, dropped = fresh(docs, "n_lines", "n_dropped")
    out = LineIndex.create(spark).insert(docs).dedup(docs, counts=(lines, dropped), indexed=True)
    if "n_chars" in docs.columns:
        now = F.when(col(out, dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(now, F.col("n_chars")))
    return out.drop(lines, dropped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Of rows that repeat that id one stays, by a hash of the row; a null id stays only in a group of null ids alone. Null and
    empty texts have the fingerprint zero and are near duplicates of each other. An empty table stays empty."""
    ship_package(spark)
    return simhash.keep_one_per_group(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row (or a whole shorter item) with ``benchmark`` go.

    A null or empty text shares nothing and stays, a null or empty item has nothing to share; repeated rows go or stay together, null
    ids are like others; an empty table stays empty. All columns are kept as they are."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences of 1024 tokens.

    A null or empty text is its end token alone; repeated rows are packed each; a null id stays null; an empty table gives no rows. The
    columns are those of ``op3_pack``: this is the last stage."""
    ship_package(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Fingerprints, trees and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
