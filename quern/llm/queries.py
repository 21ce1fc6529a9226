"""The registered queries: each operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_pack_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op4_language_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language import language_predictions

    return language_predictions(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.tokens import encode_round_trip

    return encode_round_trip(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontaminate import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secrets import span_digest

    return span_digest(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import toxicity_predictions

    return toxicity_predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.cuckoo import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_divergence, op2_pack_islands, op3_url_trees, op4_language_ranks, op5_token_files, op6_decontaminate, op7_suffix_merge, op8_secret_scan, op9_ngram_jaccard, op10_toxicity_kernel, op11_exact_cuckoo, op12_spelling_trie, op13_hard_negatives, pipeline)}


def oracles() -> dict[str, str]:
    from quern.llm import cuckoo, decontaminate, negatives

    return {"op6_decontaminate": decontaminate.ORACLE, "op11_exact_cuckoo": cuckoo.ORACLE, "op13_hard_negatives": negatives.ORACLE}
