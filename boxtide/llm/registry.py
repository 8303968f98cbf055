"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, collocations, fingerprints, html_text, katz, line_dedup, near_dedup, packing, quality_model, quality_rules, sentencepieces, toxicity, vector_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_fingerprints": fingerprints.query,
    "op4_sentencepieces": sentencepieces.query,
    "op5_quality_rules": quality_rules.query,
    "op6_html_text": html_text.query,
    "op7_quality_model": quality_model.query,
    "op8_packing": packing.query,
    "op9_katz": katz.query,
    "op10_near_dedup": near_dedup.query,
    "op11_collocations": collocations.query,
    "op12_centroids": centroids.query,
    "op13_vector_graph": vector_graph.query,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": quality_rules.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_collocations": collocations.SQL,
    "op12_centroids": centroids.SQL,
    "op13_vector_graph": vector_graph.SQL,
}
