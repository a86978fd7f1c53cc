"""Queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliary.llm.op1_sharding import op1_ring_shards
from foliary.llm.op10_token_ids import op10_huffman_ids
from foliary.llm.op2_language import op2_language
from foliary.llm.op3_pieces import op3_merge_dropout
from foliary.llm.op4_simhash import op4_simhash
from foliary.llm.op5_sampling import op5_sampling
from foliary.llm.op6_mix import ORACLE as OP6
from foliary.llm.op6_mix import op6_mix
from foliary.llm.op7_licenses import ORACLE as OP7
from foliary.llm.op7_licenses import op7_license_scan
from foliary.llm.op8_topk import ORACLE as OP8
from foliary.llm.op8_topk import op8_topk
from foliary.llm.op9_pii import op9_pii_surrogates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ring_shards": op1_ring_shards,
    "op2_language": op2_language,
    "op3_merge_dropout": op3_merge_dropout,
    "op4_simhash": op4_simhash,
    "op5_sampling": op5_sampling,
    "op6_mix": op6_mix,
    "op7_license_scan": op7_license_scan,
    "op8_topk": op8_topk,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_huffman_ids": op10_huffman_ids,
}

ORACLES: dict[str, str] = {
    "op6_mix": OP6,
    "op7_license_scan": OP7,
    "op8_topk": OP8,
}
