"""Queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from quadrill.llm import ann, conversations, decontaminate, html_text, jaccard, langid, licences, mixing, packing, periods, pii, quality, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_langid": langid.op2_langid,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_mixing": mixing.op4_mixing,
        "op5_warc": warc.op5_warc,
        "op6_pii": pii.op6_pii,
        "op7_licences": licences.op7_licences,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_html": html_text.op9_html,
        "op10_quality": quality.op10_quality,
        "op11_runs": periods.op11_runs,
        "op12_conversations": conversations.op12_conversations,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op5_warc": warc.OP5_SQL,
        "op8_jaccard": jaccard.OP8_SQL,
        "op11_runs": periods.OP11_SQL,
        "op12_conversations": conversations.OP12_SQL,
    }
