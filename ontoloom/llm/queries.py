"""The queries of this subpackage, and SQL for those that SQL can express at whole-table cost."""

from __future__ import annotations

from ontoloom.llm import alignment, clustering, decontam, embedding_dedup, mixing, neardup, ngram_rules, quality, substring_dedup, token_io, toxicity, urlfilter, warc

QUERIES = {
    f.__name__: f
    for f in (
        token_io.op1_token_ids,
        quality.op2_quality_classifier,
        warc.op3_resolve_revisits,
        toxicity.op4_toxicity,
        decontam.op5_decontaminate,
        ngram_rules.op6_quality_rules,
        neardup.op7_minhash_near_dedup,
        urlfilter.op8_url_filter,
        mixing.op9_mix_sources,
        substring_dedup.op10_suffix_dedup,
        embedding_dedup.op11_embedding_near_dedup,
        alignment.op12_cross_tokenizer_alignment,
        clustering.op13_centroid_clustering,
    )
}

ORACLE_SQL = {"op3_resolve_revisits": warc.OP3_SQL, "op8_url_filter": urlfilter.OP8_SQL, "op9_mix_sources": mixing.OP9_SQL, "op11_embedding_near_dedup": embedding_dedup.OP11_SQL, "op13_centroid_clustering": clustering.OP13_SQL}
