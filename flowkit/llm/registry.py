"""The queries of this subpackage: thin uses of its operators on whole tables, and SQL where it can express them."""

from __future__ import annotations

from flowkit.llm import byte_bpe, decontaminate, exact_dedup, html_text, jaccard_join, language_id, media_sequences, mixing, pii, substring_dedup, token_alignment, url_reputation, vector_codes
from flowkit.llm.common import table

QUERIES = {
    "op1_source_mix": lambda spark, sf_dir: mixing.mix_sizes(table(spark, sf_dir, "documents")),
    "op2_html_extraction": lambda spark, sf_dir: html_text.extract_text(table(spark, sf_dir, "pages")),
    "op3_suffix_dedup": lambda spark, sf_dir: substring_dedup.remove_repeats(table(spark, sf_dir, "documents")),
    "op4_media_columns": lambda spark, sf_dir: media_sequences.document_media(table(spark, sf_dir, "documents")),
    "op5_exact_dedup": lambda spark, sf_dir: exact_dedup.label_copies(table(spark, sf_dir, "documents")),
    "op6_personal_data": lambda spark, sf_dir: pii.find_personal_data(table(spark, sf_dir, "documents")),
    "op7_url_filters": lambda spark, sf_dir: url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
    "op8_language_id": lambda spark, sf_dir: language_id.identify(table(spark, sf_dir, "documents")),
    "op9_jaccard_join": lambda spark, sf_dir: jaccard_join.components(table(spark, sf_dir, "documents")),
    "op10_byte_bpe": lambda spark, sf_dir: byte_bpe.encode_documents(table(spark, sf_dir, "documents")),
    "op11_vector_codes": lambda spark, sf_dir: vector_codes.compress_vectors(table(spark, sf_dir, "embeddings")),
    "op12_benchmark_decontamination": lambda spark, sf_dir: decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_token_alignment": lambda spark, sf_dir: token_alignment.align_documents(table(spark, sf_dir, "documents")),
}

ORACLE = {"op11_vector_codes": vector_codes.ORACLE, "op12_benchmark_decontamination": decontaminate.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op7_url_filters": url_reputation.ORACLE}
