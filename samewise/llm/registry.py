"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from samewise.llm import archives, decontamination, language, licenses, mixing, passages, personal, quality, sharding, simhash

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_language": language.query,
    "op3_mixing": mixing.query,
    "op4_decontamination": decontamination.query,
    "op5_simhash": simhash.query,
    "op6_archives": archives.query,
    "op7_personal": personal.query,
    "op8_quality": quality.query,
    "op9_passages": passages.query,
    "op10_licenses": licenses.query,
}
ORACLE = {
    "op1_sharding": sharding.SQL,
    "op3_mixing": mixing.SQL,
    "op4_decontamination": decontamination.SQL,
    "op6_archives": archives.SQL,
    "op8_quality": quality.SQL,
    "op9_passages": passages.SQL,
}
