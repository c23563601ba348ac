"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import decontamination, fillmiddle, filteraudit, licenses, linededup, mixing, personal, quality, setjoin, substrings, tokenbits, tokencounts, warc


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1,
        "op2_decontamination": decontamination.op2,
        "op3_substring_dedup": substrings.op3,
        "op4_license_scan": licenses.op4,
        "op5_token_counts": tokencounts.op5,
        "op6_set_join": setjoin.op6,
        "op7_line_dedup": linededup.op7,
        "op8_token_bits": tokenbits.op8,
        "op9_warc": warc.op9,
        "op10_quality": quality.op10,
        "op11_filter_audit": filteraudit.op11,
        "op12_personal_data": personal.op12,
        "op13_fill_middle": fillmiddle.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op3_substring_dedup": substrings.ORACLE, "op6_set_join": setjoin.ORACLE, "op7_line_dedup": linededup.ORACLE, "op9_warc": warc.ORACLE, "op11_filter_audit": filteraudit.ORACLE, "op13_fill_middle": fillmiddle.ORACLE}
