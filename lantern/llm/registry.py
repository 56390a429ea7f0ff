"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from lantern.llm import chats, decontaminate, htmltext, jaccard, language, licenses, media, mixing, negatives, runs, secrets, suffixes, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_licenses": licenses.op3_licenses,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_html": htmltext.op5_html,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language": language.op7_language,
    "op8_secrets": secrets.op8_secrets,
    "op9_media": media.op9_media,
    "op10_suffixes": suffixes.op10_suffixes,
    "op11_chats": chats.op11_chats,
    "op12_negatives": negatives.op12_negatives,
    "op13_runs": runs.op13_runs,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op2_jaccard": jaccard.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op11_chats": chats.SQL,
    "op12_negatives": negatives.SQL,
}
