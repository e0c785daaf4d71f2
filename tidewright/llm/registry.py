"""The corpus queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, html, language, packing, quality, secrets, simhash, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": urls.op1_urls,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_quality": quality.op3_quality,
    "op4_vectors": vectors.op4_vectors,
    "op5_language": language.op5_language,
    "op6_secrets": secrets.op6_secrets,
    "op7_simhash": simhash.op7_simhash,
    "op8_pack": packing.op8_pack,
    "op9_html": html.op9_html,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op4_vectors": vectors.SQL}
