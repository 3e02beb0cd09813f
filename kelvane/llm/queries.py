"""The queries of this subpackage by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from kelvane.llm import cotrain, exact, lines, mixing, packing, simhash, sketch, substring, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_quality": cotrain.op2_quality,
        "op3_fingerprints": sketch.op3_fingerprints,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_simhash": simhash.op6_simhash,
        "op7_exact_dedup": exact.op7_exact_dedup,
        "op8_packing": packing.op8_packing,
        "op9_mixing": mixing.op9_mixing,
        "op10_substring_dedup": substring.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.oracle(), "op7_exact_dedup": exact.ORACLE, "op9_mixing": mixing.ORACLE}
