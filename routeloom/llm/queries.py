"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dualtree, fingerprint, html_text, katz, langid, mixing, neardup, packing, pii, sharding, topk, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": mixing.op1_mix,
    "op2_pack": packing.op2_pack,
    "op3_topk": topk.op3_topk,
    "op4_neardup": neardup.op4_neardup,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_html": html_text.op6_html,
    "op7_katz": katz.op7_katz,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_pii": pii.op9_pii,
    "op10_langid": langid.op10_langid,
    "op11_search": dualtree.op11_search,
    "op12_shard": sharding.op12_shard,
    "op13_whiten": whitening.op13_whiten,
}
SQL: dict[str, str] = {"op3_topk": topk.OP3_SQL, "op8_url_filter": url_filter.OP8_SQL, "op11_search": dualtree.OP11_SQL}
