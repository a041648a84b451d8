"""Declarative rules held against results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def _hits(tokens: Column, text: Column) -> Column:
    return F.filter(tokens, lambda t: F.contains(text, F.lower(t)))


def evaluate(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Each rule with its result by path; a path without a result has failed."""
    r = rules.join(results, "path", "left").withColumns({
        "actual_success": F.coalesce("success", F.lit(False)), "text": strip(F.coalesce("text", F.lit(""))),
        "must_contain": F.coalesce("must_contain", F.array().cast("array<string>")), "must_not_contain": F.coalesce("must_not_contain", F.array().cast("array<string>")),
        "error": F.when(F.col("success").isNull(), F.concat(F.lit("文件不存在: "), "path")).otherwise(F.coalesce("error", F.lit(""))),
        "processing_ms": F.coalesce("processing_ms", F.lit(0.0)),
    })
    low = F.lower("text")
    r = r.withColumns({"actual_char_count": F.coalesce("char_count", F.length("text").cast("long")), "must_contain_hits": _hits(F.col("must_contain"), low), "must_not_contain_hits": _hits(F.col("must_not_contain"), low)})
    r = r.withColumns({
        "success_match": F.coalesce(F.col("actual_success") == F.col("expected_success"), F.lit(True)),
        "min_char_pass": F.coalesce(F.col("actual_char_count") >= F.col("min_char_count"), F.lit(True)),
        "contains_pass": F.size("must_contain_hits") == F.size("must_contain"), "excludes_pass": F.size("must_not_contain_hits") == 0,
    })
    r = r.withColumn("rule_passed", F.col("success_match") & F.col("min_char_pass") & F.col("contains_pass") & F.col("excludes_pass"))
    return r.select(
        "path", "expected_success", "actual_success", "success_match", "min_char_count", "actual_char_count", "min_char_pass", "must_contain", "must_contain_hits",
        "contains_pass", "must_not_contain", "must_not_contain_hits", "excludes_pass", "processing_ms", "error", "rule_passed", *[c for c in ("notes",) if c in rules.columns],
    )


def summarize(results: DataFrame) -> DataFrame:
    n, passed = F.count("*"), F.count_if("rule_passed")
    wanted, least = F.size("must_contain") > 0, F.col("min_char_count").isNotNull()
    cents = F.sum(F.round(F.col("processing_ms") * 100).cast("long")) / 100.0
    return results.agg(
        n.alias("total"), passed.alias("passed"), (n - passed).alias("failed"), F.when(n > 0, F.round(passed * 100 / n, 2)).otherwise(0.0).alias("pass_rate_pct"),
        F.count_if("success_match").alias("success_match_count"), F.count_if(wanted).alias("contains_checked"), F.count_if(wanted & F.col("contains_pass")).alias("contains_passed"),
        F.count_if(least).alias("min_char_checked"), F.count_if(least & F.col("min_char_pass")).alias("min_char_passed"),
        F.when(n > 0, F.round(cents / n, 2)).otherwise(0.0).alias("avg_processing_ms"),
    )
