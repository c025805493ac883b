"""The corpus pipeline: stages over the documents, each with an operator of prunecluster.llm."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from prunecluster.llm import exact_dedup, langid, packing, simhash
from prunecluster.llm.batches import public_tokenizer
from prunecluster.storage import shared_folder

STAGES = [
    ("language ID", lambda spark, docs, sf_dir: langid.keep_languages(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_dedup.drop_copies(docs)),
    ("SimHash near-dedup", lambda spark, docs, sf_dir: simhash.drop_near_copies(docs)),
    ("best-fit packing", lambda spark, docs, sf_dir: packing.pack_documents(docs, public_tokenizer())),
]

#: Tokens and fitted probabilities are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read by the next.

    Returns the packed pieces of the last stage. Rows without a language (null, empty and letterless texts) go first, then all
    but one of equal texts, of near copies and of rows that repeat; what has no doc_id takes part like any other. An empty
    table gives no rows. Extra columns are carried up to the packing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{root}/{number}")
        docs = spark.read.schema(result.schema).parquet(f"{root}/{number}")
    return docs
