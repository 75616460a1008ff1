"""The registered queries of this subpackage and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from weald.llm import bpe, jaccard, licenses, lines, merkle, neighbours, packing, pii, quality, secret_scan, toxicity, tries, urls


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_urls": urls.op2_urls,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_quality": quality.op4_quality,
        "op5_bpe": bpe.op5_bpe,
        "op6_pii": pii.op6_pii,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_lines": lines.op9_lines,
        "op10_packing": packing.op10_packing,
        "op11_trie": tries.op11_trie,
        "op12_secrets": secret_scan.op12_secrets,
        "op13_manifest": merkle.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.op1_sql(),
        "op2_urls": urls.op2_sql(),
        "op8_neighbours": neighbours.op8_sql(),
        "op11_trie": tries.op11_sql(),
        "op12_secrets": secret_scan.op12_sql(),
        "op13_manifest": merkle.op13_sql(),
    }
