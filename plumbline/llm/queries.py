"""Queries of the training-data operators: one for each, over whole tables."""

from __future__ import annotations

from plumbline.llm import oracles
from plumbline.llm.decontamination import op5
from plumbline.llm.fingerprints import op12
from plumbline.llm.language import op1
from plumbline.llm.manifest import op13
from plumbline.llm.mixing import op7
from plumbline.llm.near_dedup import op8
from plumbline.llm.quality_model import op6
from plumbline.llm.quality_rules import op4
from plumbline.llm.secrets import op10
from plumbline.llm.sharding import op9
from plumbline.llm.suffix_dedup import op2
from plumbline.llm.whitening import op11
from plumbline.llm.window_dedup import op3

QUERIES = {
    "op1_language_id": op1,
    "op2_suffix_dedup": op2,
    "op3_substring_dedup": op3,
    "op4_quality_rules": op4,
    "op5_decontamination": op5,
    "op6_quality_classifier": op6,
    "op7_mixing": op7,
    "op8_near_dedup": op8,
    "op9_sharding": op9,
    "op10_secret_scan": op10,
    "op11_whitening": op11,
    "op12_phrase_fingerprints": op12,
    "op13_merkle_manifest": op13,
}
#: The others draw on trained models, seeded hashes or a vocabulary; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_quality_rules": oracles.QUALITY_RULES,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op8_near_dedup": oracles.NEAR_DEDUP,
    "op13_merkle_manifest": oracles.merkle_manifest(),
}
