"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablehaul.llm import (
    alignment,
    decontamination,
    language,
    merkle,
    ngram_join,
    pii,
    pu_quality,
    quality_rules,
    sentencepiece_scan,
    sharding,
    simhash,
    substring_dedup,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pii.op1_gradient_boosted_pii,
        ngram_join.op2_ngram_jaccard_join,
        decontamination.op3_latent_decontamination,
        language.op4_hierarchical_language_id,
        sharding.op5_extendible_shards,
        pu_quality.op6_positive_unlabelled_quality,
        warc.op7_normalised_warc,
        substring_dedup.op8_seed_extend_dedup,
        sentencepiece_scan.op9_sentencepiece_scan,
        quality_rules.op10_quality_rules,
        merkle.op11_nested_merkle_manifest,
        alignment.op12_perfect_hash_alignment,
        simhash.op13_segment_popcount_simhash,
    )
}

ORACLES: dict[str, str] = {
    "op5_extendible_shards": sharding.oracle(),
    "op7_normalised_warc": warc.ORACLE,
    "op8_seed_extend_dedup": substring_dedup.ORACLE,
    "op11_nested_merkle_manifest": merkle.ORACLE,
}
