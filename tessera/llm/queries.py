"""Queries and oracle SQL of this subpackage."""

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, funnels, hard_negatives, html_extract, jaccard_join, language_id, license_scan, matroska, mixture, packing, quality, token_files, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_license_scan": license_scan.query,
    "op2_quality": quality.query,
    "op3_url_filter": url_filter.query,
    "op4_html_extract": html_extract.query,
    "op5_packing": packing.query,
    "op6_mixture": mixture.query,
    "op7_language_id": language_id.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_matroska": matroska.query,
    "op10_fingerprints": fingerprints.query,
    "op11_funnels": funnels.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_token_files": token_files.query,
}

ORACLES = {
    "op1_license_scan": license_scan.oracle,
    "op3_url_filter": url_filter.oracle,
    "op6_mixture": mixture.oracle,
    "op11_funnels": funnels.oracle,
    "op12_hard_negatives": hard_negatives.oracle,
}
