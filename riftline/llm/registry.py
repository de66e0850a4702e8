"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from riftline.llm import ann, html, jaccard, langid, licenses, mixing, packing, pii, quality, rules

QUERIES = {
    "op1_html_text": html.op1_html_text,
    "op2_quality_grades": quality.op2_quality_grades,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_nearest_neighbours": ann.op5_nearest_neighbours,
    "op6_language_id": langid.op6_language_id,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_pack_documents": packing.op10_pack_documents,
}

ORACLES = {"op4_jaccard_join": jaccard.ORACLE, "op8_mix_sources": mixing.ORACLE}
