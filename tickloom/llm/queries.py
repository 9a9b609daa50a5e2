"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tickloom.llm import decontamination, exact_dedup, fill_middle, jaccard_join, language_id, line_dedup, mixing, periodic_runs, quality, simhash, substring_dedup, token_output, toxicity


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_language_id": language_id.query,
        "op3_mixing": mixing.query,
        "op4_substring_dedup": substring_dedup.query,
        "op5_line_dedup": line_dedup.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_toxicity": toxicity.query,
        "op8_quality": quality.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_token_output": token_output.query,
        "op11_fill_middle": fill_middle.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op4_substring_dedup": substring_dedup.SQL, "op5_line_dedup": line_dedup.SQL, "op6_jaccard_join": jaccard_join.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_fill_middle": fill_middle.SQL}
