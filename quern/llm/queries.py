"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from . import embedding_dedup, exact_dedup, language_id, minhash, mixing, pieces, secrets, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_id": language_id.op6_language_id,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_minhash": minhash.op9_minhash,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
}
