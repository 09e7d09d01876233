"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from corpusloom.llm import ann, chat, licenses, mixing, phrases, quality, sentencepiece_fst, simhash, substrings, token_files, toxicity, vector_dups, whitening


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_token_orc": token_files.op3_token_orc,
        "op4_sentencepiece": sentencepiece_fst.op4_sentencepiece,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_simhash": simhash.op8_simhash,
        "op9_ann": ann.op9_ann,
        "op10_vector_dups": vector_dups.op10_vector_dups,
        "op11_phrases": phrases.op11_phrases,
        "op12_quality": quality.op12_quality,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.OP7_SQL, "op11_phrases": phrases.OP11_SQL}
