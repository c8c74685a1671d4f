"""The queries of this subpackage and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, mixing, secrets, sharding, simhash, substrings, topk, toxicity, url_rules
from .sql import TWINS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rendezvous_sharding": sharding.op1_rendezvous_sharding,
        "op2_template_decontamination": decontaminate.op2_template_decontamination,
        "op3_url_rules": url_rules.op3_url_rules,
        "op4_nra_topk": topk.op4_nra_topk,
        "op5_secret_ownership": secrets.op5_secret_ownership,
        "op6_hierarchical_mix": mixing.op6_hierarchical_mix,
        "op7_chat_format": chat.op7_chat_format,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_fm_toxicity": toxicity.op9_fm_toxicity,
        "op10_lsm_substring_dedup": substrings.op10_lsm_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {name: TWINS[name] for name in queries() if name in TWINS}
