"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import hard_negatives, licenses, mixing, packing, passages, periodic, quality, secret_scan, sharding, simhash, topk, url_filter, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_licenses": licenses.op3_licenses,
    "op4_passages": passages.op4_passages,
    "op5_sharding": sharding.op5_sharding,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_topk": topk.op7_topk,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_runs": periodic.op12_runs,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL = {
    "op3_licenses": licenses.SQL,
    "op6_secrets": secret_scan.SQL,
    "op7_topk": topk.SQL,
    "op8_mixing": mixing.SQL,
    "op9_quality": quality.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_warc": warc.SQL,
}
