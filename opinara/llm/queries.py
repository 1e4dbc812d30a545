"""The corpus operators' queries and their DuckDB SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import (
    decontamination, exact_dedup, hard_negatives, language, lattice, line_dedup, merkle, near_dedup, quality, simhash,
    toxicity, url_rules
)
from .packing import op10_packing

QUERIES = {
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op4_lattice_lm": lattice.op4_lattice_lm,
    "op3_toxicity": toxicity.op3_toxicity,
    "op1_language": language.op1_language,
    "op9_quality": quality.op9_quality,
    "op2_decontamination": decontamination.op2_decontamination,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op8_url_rules": url_rules.op8_url_rules,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op2_decontamination": decontamination.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_url_rules": url_rules.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
