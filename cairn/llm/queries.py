"""The queries of the operators of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op1_pii, op2_licenses, op3_shards, op4_jaccard, op5_html, op6_preference, op7_mix, op8_decontaminate, op9_rules, op10_rulefit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered query where none is set: public, so its pseudonyms hide nothing from who reads this.
QUERY_KEY = "cairn"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.digest(table(spark, sf_dir, "documents"), spark.conf.get(op1_pii.KEY_CONF, None) or QUERY_KEY)


def op2_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses.licenses(table(spark, sf_dir, "documents"))


def op3_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_shards.shard(table(spark, sf_dir, "documents"), shards=8)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard.join(table(spark, sf_dir, "documents"))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_html.main_text(table(spark, sf_dir, "pages"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_preference.digest(table(spark, sf_dir, "conversations"))


def op7_mix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mix.taken(table(spark, sf_dir, "documents"))


def mix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block of which source stands at which position of which output shard of the mix."""
    return op7_mix.order(table(spark, sf_dir, "documents"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = op9_rules.apply_policy(op9_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")
    base = led["failed_bits"].bitwiseAND(op9_rules.mask_of("v1")) != 0
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return led.select(*cols, base.alias("base_failed"), "kept", "failed_bits", "policy")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strictest policy rejects, by itself and beside others, from the ledger's bits."""
    return op9_rules.ablations(op9_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v3")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_rulefit.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_feistel_pseudonyms, op2_license_windows, op3_consistent_hash_shards, op4_jaccard_join, op5_text_density, op6_preference_pairs, op7_mix_blocks, op8_wu_manber, op9_rule_ledger, op10_rule_ensemble, rule_ablations, mix_order)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLE

    return dict(ORACLE)
