"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, lang_id, line_dedup, mixing, near_dup, perspectives, pii, quality, secret_scan, toxicity


def queries() -> dict:
    return {
        "op1_isolation_forest_quality": quality.query,
        "op2_assignment_secret_scan": secret_scan.query,
        "op3_perspective_rotation": perspectives.query,
        "op4_sainte_lague_mixing": mixing.query,
        "op5_factorization_toxicity": toxicity.query,
        "op6_fm_index_decontamination": decontaminate.query,
        "op7_anchor_expansion_pii": pii.query,
        "op8_minhash_line_dedup": line_dedup.query,
        "op9_kneser_ney_language_id": lang_id.query,
        "op10_probminhash_near_dedup": near_dup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_perspective_rotation": perspectives.sql(),
        "op4_sainte_lague_mixing": mixing.sql(),
    }
