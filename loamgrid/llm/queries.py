"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from loamgrid.llm import bpe, compression, decontaminate, embeddings, html, langid, quality, simhash, suffix, toxicity

QUERIES = {
    "op1_embedding_near_dup": embeddings.query,
    "op2_html_extract": html.query,
    "op3_byte_bpe": bpe.query,
    "op4_compression_lm": compression.query,
    "op5_toxicity": toxicity.query,
    "op6_simhash": simhash.query,
    "op7_decontaminate": decontaminate.query,
    "op8_language_id": langid.query,
    "op9_quality": quality.query,
    "op10_suffix_dedup": suffix.query,
}

ORACLE = {
    "op1_embedding_near_dup": embeddings.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_suffix_dedup": suffix.ORACLE,
}
