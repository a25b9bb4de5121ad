"""Queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprints, jaccard, licenses, mixing, oracles, pii, quality, sharding, token_files, topk


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_top_products": topk.op2_top_products,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_pfair_mix": mixing.op4_pfair_mix,
        "op5_jaccard_join": jaccard.op5_jaccard_join,
        "op6_closed_syncmers": fingerprints.op6_closed_syncmers,
        "op7_pii": pii.op7_pii,
        "op8_token_counts": token_files.op8_token_counts,
        "op9_rendezvous_shards": sharding.op9_rendezvous_shards,
        "op10_mil_quality": quality.op10_mil_quality,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
