"""Queries and SQL of this subpackage, for the entry module to add."""

from __future__ import annotations

from . import decontaminate, embed_dedup, fill_middle, filter_audit, html_text, language, lm_score, packing, quality, simhash, token_files, toxicity, url_rules


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_html_text": html_text.op2_html_text,
        "op3_simhash": simhash.op3_simhash,
        "op4_quality": quality.op4_quality,
        "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
        "op6_token_files": token_files.op6_token_files,
        "op7_packing": packing.op7_packing,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_url_rules": url_rules.op10_url_rules,
        "op11_language": language.op11_language,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_rules": url_rules.OP10_SQL, "op12_fill_middle": fill_middle.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
