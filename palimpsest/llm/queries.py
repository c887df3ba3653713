"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_ann, op10_jaccard, op11_audit, op12_collocations, op13_language, op2_topk, op3_license, op4_mix, op5_suffix, op6_toxicity, op7_warc, op8_pieces, op9_lm
from .common import table


def op1_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_topk.topk(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_license.scan(table(spark, sf_dir, "documents"))


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mix.mix(table(spark, sf_dir, "documents"))


def op6_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_warc.round_trip(table(spark, sf_dir, "pages"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lm.score(table(spark, sf_dir, "documents"))


def op10_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.classes(table(spark, sf_dir, "documents")).drop("row", "h", "class", "worded")


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_suffix.deduplicate(table(spark, sf_dir, "documents"))


def op8_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pieces.round_trip(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_language.predict(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_multiprobe_lsh, op2_segment_topk, op3_license_scan, op4_sainte_lague_mix,
                                   op6_pu_toxicity, op7_warc_zstd, op9_context_mixing, op10_lsh_forest_join, op5_run_length_dedup, op8_max_plus_pieces,
                                   op11_filter_audit, op12_collocations_fst, op13_hyperdimensional_language)}


def oracle_sql() -> dict[str, str]:
    return {"op2_segment_topk": op2_topk.ORACLE, "op3_license_scan": op3_license.oracle(), "op7_warc_zstd": op7_warc.ORACLE,
            "op11_filter_audit": op11_audit.ORACLE, "op12_collocations_fst": op12_collocations.ORACLE}
