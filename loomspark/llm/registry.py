"""Queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe
from .conv_repair import OP12_SQL, op12_conversations
from .fim import OP11_SQL, op11_fim
from .license_scan import op3_licenses
from .minhash import OP4_SQL, op4_minhash
from .mixing import OP7_SQL, op7_mixing
from .quality import OP9_SQL, op9_quality
from .sharding import op6_sharding
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .suffix_dedup import OP13_SQL, op13_suffix_dedup
from .topk import OP5_SQL, op5_topk
from .toxicity import op1_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_licenses": op3_licenses,
    "op4_minhash": op4_minhash,
    "op5_topk": op5_topk,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_fim": op11_fim,
    "op12_conversations": op12_conversations,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op4_minhash": OP4_SQL,
    "op5_topk": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_quality": OP9_SQL,
    "op11_fim": OP11_SQL,
    "op12_conversations": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
