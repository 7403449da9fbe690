"""The queries of this subpackage, one for each operator, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op6_positional_index
from .extraction import op12_block_labeller
from .licenses import op3_rare_word_index
from .linedup import OP2_SQL, op2_line_dedup
from .minhash import op1_bag_minhash
from .ngram import op7_kneser_ney
from .packing import op4_length_buckets
from .quality import op9_risk_controlled
from .resample import OP13_SQL, op13_id_tuples
from .search import OP11_SQL, op11_term_postings
from .secrets import op5_credential_links
from .toxicity import op10_weak_supervision
from .urls import OP8_SQL, op8_blocked_bloom

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_rare_word_index": op3_rare_word_index,
    "op4_length_buckets": op4_length_buckets,
    "op5_credential_links": op5_credential_links,
    "op6_positional_index": op6_positional_index,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_blocked_bloom": op8_blocked_bloom,
    "op9_risk_controlled": op9_risk_controlled,
    "op10_weak_supervision": op10_weak_supervision,
    "op11_term_postings": op11_term_postings,
    "op12_block_labeller": op12_block_labeller,
    "op13_id_tuples": op13_id_tuples,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op8_blocked_bloom": OP8_SQL,
    "op11_term_postings": OP11_SQL,
    "op13_id_tuples": OP13_SQL,
}
