"""The package's registered queries and their DuckDB SQL."""

from __future__ import annotations

from lumenframe.llm import bpe, divergence, embeddings, fingerprint, hard_negatives, language_id, language_model, licenses, minhash, mixing, sharding, toxicity, warc

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op10_lm_scores": language_model.op10_lm_scores,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_language_id": language_id.op12_language_id,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_document_fingerprints": fingerprint.op3_document_fingerprints,
    "op4_embedding_dedup": embeddings.op4_embedding_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_bpe_codec": bpe.op6_bpe_codec,
    "op7_shard_documents": sharding.op7_shard_documents,
    "op8_warc_archives": warc.op8_warc_archives,
    "op9_toxicity": toxicity.op9_toxicity,
}
ORACLE_SQL = {**minhash.ORACLE_SQL, **embeddings.ORACLE_SQL, **mixing.ORACLE_SQL, **warc.ORACLE_SQL, **divergence.ORACLE_SQL, **hard_negatives.ORACLE_SQL}
