"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontaminate, nearjoin, packing, pii, quality
from rankloom.llm.common import new_path, table
from rankloom.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents of its own input, doesn't reject. Null and empty texts are scored like others."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_from=quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by near similarity, the document with the smallest id; of rows equal in id and text, one. Texts without words stay."""
    return nearjoin.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth; a text without words, null included, stays."""
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark"), keep=True)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null and empty texts stay as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("decontaminate", drop_contaminated), ("personal_data", hide_personal_data), ("pack", pack)]
#: Trees fitted by boosting, iterative pattern scores and packing have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := new_path(spark, f"pipeline-{name}"))
            docs = spark.read.parquet(path)
    return docs
