"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from quillstone.llm import centroids, divergence, embed_dedup, langid, licenses, mixing, packing, pii, quality, simhash, token_rollup, url_filter, warc


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_warc": warc.op2_warc,
        "op3_mixing": mixing.op3_mixing,
        "op4_token_rollup": token_rollup.op4_token_rollup,
        "op5_simhash": simhash.op5_simhash,
        "op6_packing": packing.op6_packing,
        "op7_langid": langid.op7_langid,
        "op8_quality": quality.op8_quality,
        "op9_embed_dedup": embed_dedup.op9_embed_dedup,
        "op10_pii": pii.op10_pii,
        "op11_licenses": licenses.op11_licenses,
        "op12_centroids": centroids.op12_centroids,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.ORACLE, "op2_warc": warc.ORACLE, "op8_quality": quality.ORACLE, "op9_embed_dedup": embed_dedup.ORACLE,
            "op11_licenses": licenses.ORACLE, "op12_centroids": centroids.ORACLE, "op13_divergence": divergence.ORACLE}
