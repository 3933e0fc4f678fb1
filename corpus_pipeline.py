"""From raw documents to packed training sequences, a stage an operator.

Each stage takes the rows that the one before wrote. All but the last return the columns of
``documents``; any further columns that the input has stay too, with their values, whatever their names. Null and empty
texts are dropped by the first stage, as they have too few words; the other stages take them as described. Empty tables
give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, packing, quality, secrets, simhash, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the isolation forest rejects.

    Null and empty texts fail the base rule. Repeated rows are judged alike; rows without an id are judged too, only never
    learned from. Without labels the base rule alone decides.
    """
    return quality.passed(docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic.

    Null and empty texts have no sentence, score 0 and stay. Repeated rows are judged alike. Without labels of both kinds
    nothing can be learned: with no toxic row among them nothing is dropped.
    """
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id.

    Of rows with that id the one with the smallest hash of its text stays, of repeated rows one; rows without an id come after
    all others. Null and empty texts are near-duplicates of one another.
    """
    return simhash.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark and ``n_chars`` the length of the new text.

    Null and empty texts and repeated rows stay as they are.
    """
    return secrets.redacted(docs, "text", "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are the end id alone; repeated rows and rows without an id are documents of their own.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The stages fit models, fingerprint and tokenize, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them.

    What a stage has staged is deleted as soon as its rows are written. The last stage's tables stay until its rows have been
    read; then ``common.clear`` deletes them. A stage that fails leaves nothing staged.
    """
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.mark()
    try:
        for number, (name, work) in enumerate(STAGES):
            docs = work(spark, docs, sf_dir)
            if number < len(STAGES) - 1:
                docs = common.stage(docs, name)
                common.clear(spark, began, but_last=True)
    except BaseException:
        common.clear(spark, began)
        raise
    return docs
