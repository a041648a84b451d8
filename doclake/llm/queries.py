"""The operators' queries, each over its whole table with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import budget, crf, cws, gam, jaccard, recompress, roles, rollup, spaced, sst
from .common import documents, folder, stash, table


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and its number of links."""
    return jaccard.links(documents(spark, sf_dir))


def op10_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeats(documents(spark, sf_dir))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced.hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, equal shares for the sources."""
    return budget.fit(documents(spark, sf_dir), total=0.5)


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, a tenth deleted again, another tenth revised to a token less, the deletes sent twice, and compaction between."""
    rows = stash(rollup.pattern_tokens(documents(spark, sf_dir)), "tokens")
    kept = rollup.Rollup(spark, folder(spark, "rollup"))
    deletes = rollup.deltas(rows, "delete", F.col("doc_id") % 10 == 3)
    kept.commit("load", rollup.deltas(rows, "insert"))
    kept.commit("deletes", deletes)
    kept.compact()
    kept.commit("deletes", deletes)
    kept.commit("revisions", rollup.deltas(rows, "revise", F.col("doc_id") % 10 == 7, F.greatest(F.col("n_tokens") - 1, F.lit(0))))
    return kept.totals()


def op5_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(documents(spark, sf_dir))


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.format_chats(table(spark, sf_dir, "conversations"))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_crf_language_id, op2_budget_mixing, op3_gam_quality, op4_token_rollup, op5_consistent_weighted_sampling,
        op6_spaced_seed_decontamination, op7_ngram_jaccard_join, op8_role_repair, op9_site_style_tree, op10_recompression_substring_dedup,
    )
}

SQL = {"op4_token_rollup": rollup.TOTALS_SQL, "op7_ngram_jaccard_join": jaccard.LINKS_SQL}
