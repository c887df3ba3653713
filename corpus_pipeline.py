"""The corpus pipeline: toxicity, near copies, repeated passages, source mixing, pieces.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import op4_mix, op5_suffix, op6_toxicity, op8_pieces, op10_jaccard
from palimpsest.llm.common import forget, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold; all others stay."""
    return op6_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return op10_jaccard.without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a smaller document holds out of the texts; every document stays a row."""
    return op5_suffix.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that the sources' words come near their targets.

    A document that the mix takes in full rounds is there as often; the part taken of a last one counts as a whole
    copy if it is half of the document or more. A document without words adds none to any share and stays once.
    """
    mixed = op4_mix.mix(docs, keep=tuple(docs.columns))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int")
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the pieces' ids (int32, little-endian) of each text."""
    encoded = op8_pieces.encode(docs, keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", "n_bytes", "n_pieces", "score", "pieces")


STAGES = [
    ("toxicity", toxicity),
    ("near copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: The stages hash, learn and search in ways that SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes as soon as the next one is written; the last one is what the result reads."""
    docs, written = table(spark, sf_dir, "documents"), ""
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark).rstrip('/')}/pipeline-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if written:
                forget(spark, written)
            written = path
    return docs
