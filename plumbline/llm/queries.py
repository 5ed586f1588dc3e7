"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from plumbline.llm import fixity, language_id, line_dedup, mixing, near_dedup, nearest, piece_bpe, quality_ledger, secret_scan, spelling, token_alignment, toxicity, wrappers
from plumbline.llm.common import table


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_language_crf": lambda s, d: language_id.query(docs(s, d)),
        "op2_rule_ledger": lambda s, d: quality_ledger.query(docs(s, d)),
        "op3_merkle_fixity": lambda s, d: fixity.query(table(s, d, "pages")),
        "op4_line_winnowing": lambda s, d: line_dedup.query(docs(s, d)),
        "op5_toxicity": lambda s, d: toxicity.query(docs(s, d), table(s, d, "labels")),
        "op6_near_dedup": lambda s, d: near_dedup.query(docs(s, d)),
        "op7_wrappers": lambda s, d: wrappers.query(table(s, d, "pages")),
        "op8_temperature_mix": lambda s, d: mixing.query(docs(s, d)),
        "op9_nearest": lambda s, d: nearest.query(table(s, d, "embeddings")),
        "op10_piece_bpe": lambda s, d: piece_bpe.query(docs(s, d)),
        "op11_guess_cost": lambda s, d: secret_scan.query(docs(s, d)),
        "op12_token_alignment": lambda s, d: token_alignment.query(docs(s, d)),
        "op13_fm_spelling": lambda s, d: spelling.query(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_rule_ledger": quality_ledger.ORACLE, "op3_merkle_fixity": fixity.ORACLE, "op8_temperature_mix": mixing.ORACLE}
