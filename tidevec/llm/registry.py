"""Queries of this subpackage and the SQL that checks them."""

from . import jaccard, langid, mixing, oracles, packing, quality, rules, sharding, suffixes, toxicity, vectors


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_embedding_near_dedup": vectors.op8_embedding_near_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_quality_rules": rules.op10_quality_rules,
    "pipeline": _pipeline,
}
ORACLE_SQL = {"op4_jaccard_join": oracles.OP4, "op8_embedding_near_dedup": oracles.OP8}
