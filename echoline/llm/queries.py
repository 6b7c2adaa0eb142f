"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from echoline.llm import chunking, conversations, decontaminate, langid, mixing, pseudolikelihood, repeats, secrets, sharding, simhash, toxicity, vectorcodes, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark, sf_dir):
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op2_repeats(spark, sf_dir):
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_language(spark, sf_dir):
    return langid.languages(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pseudolikelihood(spark, sf_dir):
    return pseudolikelihood.score_documents(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return chunking.fingerprints(_table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op10_sharding(spark, sf_dir):
    return sharding.sharded_documents(_table(spark, sf_dir, "documents"))


def op11_codes(spark, sf_dir):
    return vectorcodes.codes(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_repair(spark, sf_dir):
    return conversations.repair(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_repeats, op3_language, op4_decontamination, op5_pseudolikelihood, op6_fingerprints, op7_simhash, op8_mixing, op9_warc, op10_sharding,
        op11_codes, op12_toxicity, op13_repair,
    )
}
ORACLES = {"op4_decontamination": decontaminate.DECON_SQL, "op8_mixing": mixing.MIX_SQL, "op9_warc": warc.WARC_SQL}
