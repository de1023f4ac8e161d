"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from faktum.llm import bpe, covertree, exact_dedup, langid, lm, mixing, ngram_join, sharding, suffix, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_embedding_dedup": covertree.op9_embedding_dedup,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
}
ORACLE_SQL = {"op1_sharding": sharding.OP1_SQL, "op3_mixing": mixing.OP3_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL, "op7_ngram_join": ngram_join.OP7_SQL, "op9_embedding_dedup": covertree.OP9_SQL}
