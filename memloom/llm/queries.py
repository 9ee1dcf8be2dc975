"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from memloom.llm import chat, decontam, filteraudit, htmltext, jaccard, langid, lmscore, mixing, mpeg, periodic, pii, records, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_pii": pii.op4_pii,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_media": mpeg.op6_media,
    "op7_token_records": records.op7_token_records,
    "op8_language_id": langid.op8_language_id,
    "op9_lm_scores": lmscore.op9_lm_scores,
    "op10_html_text": htmltext.op10_html_text,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_chat_format": chat.op13_chat_format,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_pii": pii.OP4_SQL,
    "op11_filter_audit": filteraudit.OP11_SQL,
    "op13_chat_format": chat.OP13_SQL,
}
