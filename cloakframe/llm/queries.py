"""The queries op1 to op10 over the documents of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import jaccard_join, language_id, language_model, license_scan, line_dedup, media, mixing, packing, quality, suffix_dedup
from .common import documents


def op1_license_scan(spark, sf_dir):
    files = documents(spark, sf_dir).withColumn("path", license_scan.path_of())
    return license_scan.scan(files)


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.ngram_jaccard_components(documents(spark, sf_dir))


def op3_media_columns(spark, sf_dir):
    return media.media_columns(documents(spark, sf_dir))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_report(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), keep=False).drop("kept")


def op6_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op7_language_model(spark, sf_dir):
    return language_model.score(documents(spark, sf_dir))


def op8_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op9_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ngram_jaccard_join, op3_media_columns, op4_line_dedup, op5_suffix_array_dedup, op6_packing, op7_language_model, op8_mixing, op9_quality_rules, op10_language_id)}
ORACLE = {"op8_mixing": mixing.ORACLE}
