"""The registered queries of this package and, where SQL can express them, their SQL."""
from moldwatch.llm import (chat, decontam, hashing, langid, licences, lm, near_dup, packing, quality, resampling, tokens, toxicity,
                           whitening)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_language": langid.op4_language,
    "op5_licences": licences.op5_licences,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_lm_score": lm.op7_lm_score,
    "op8_quality": quality.op8_quality,
    "op9_chat": chat.op9_chat,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_neighbours": hashing.op11_neighbours,
    "op12_resample": resampling.op12_resample,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_packing": packing.OP1_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op5_licences": licences.OP5_SQL,
    "op6_near_dup": near_dup.OP6_SQL,
    "op8_quality": quality.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op12_resample": resampling.OP12_SQL,
}
