"""Training-data operators: each module holds one operator and its registered query.

Nothing outside this subpackage imports it.  ``QUERIES`` maps the registered query names to
callables ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps those that SQL can express to
their DuckDB statement.
"""

from patternloom.llm import audit, bpe, clusters, decontaminate, embeddings, exact, licences, lines, ngram, pii, quality, toxicity, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_jaccard": ngram.op2_ngram_jaccard,
    "op3_quality": quality.op3_quality,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_url_filter": urls.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_licence_scan": licences.op9_licence_scan,
    "op10_embedding_dedup": embeddings.op10_embedding_dedup,
    "op11_exact_dedup": exact.op11_exact_dedup,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_centroid_clusters": clusters.op13_centroid_clusters,
}
ORACLES = {"op6_url_filter": urls.ORACLE, "op11_exact_dedup": exact.ORACLE, "op12_filter_audit": audit.ORACLE, "op13_centroid_clusters": clusters.ORACLE}
