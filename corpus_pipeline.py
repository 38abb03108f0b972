"""The corpus pipeline: STAGES applied to the documents, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sleuthframe.cluster import remove, ship
from sleuthframe.llm import bpe, contamination, language_id, near_dup, repeats
from sleuthframe.llm.common import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id.keep_identified),
    ("MinHash near-dedup", near_dup.drop_near_duplicates),
    ("suffix-array dedup", repeats.drop_repeats),
    ("benchmark decontamination", contamination.drop_leaks),
    ("BPE encoding", bpe.encode_stage),
]

#: Classifier, near-duplicate search and tokenizer are beyond SQL; each stage's operator has a test against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder, read as the next one's input and then deleted. The last one stays, as the rows are read from it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, docs, sf_dir)
        path = f"{base}/{k}"
        df.write.parquet(path)
        docs = spark.read.schema(df.schema).parquet(path)
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
