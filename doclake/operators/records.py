"""Batch records: one row per processed file, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import classify
from ..functions.text import one_line

CSV_COLUMNS = """
    suite filename extension size_bytes expected_success success matches_expectation char_count
    table_count processing_ms parse_method ocr_engine error_category error path
""".split()


def expected(results: DataFrame, expectations: DataFrame, on: list[str]) -> DataFrame:
    """Results with what was expected of them; null where nothing is known. The planner broadcasts a small table of expectations."""
    joined = results.join(expectations, on, "left")
    return joined.withColumn("matches_expectation", F.col("success") == F.col("expected_success"))


def with_errors(records: DataFrame, error: str = "error") -> DataFrame:
    return records.withColumn("error_info", classify(F.col(error))).withColumn("error_category", F.coalesce("error_info.category", F.lit("")))


def _rate(part: Column, whole: Column, times: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * times / whole, 2)).otherwise(0.0).cast("double")


def measures() -> list[Column]:
    n, ok = F.count("*"), F.count_if("success")
    # cents are added as whole numbers, so the order of addition doesn't matter
    return [
        n.alias("total"), ok.alias("success"), (n - ok).alias("failed"), F.sum("char_count").alias("char_count_total"), F.sum("table_count").alias("table_count_total"),
        _rate(ok, n, 100).alias("success_rate_pct"), _rate(F.sum(F.round(F.col("processing_ms") * 100).cast("long")) / 100.0, n).alias("avg_processing_ms"),
    ]


def extension_or_none() -> Column:
    return F.coalesce(F.nullif(F.col("extension"), F.lit("")), F.lit("<none>"))


def batch_summary(records: DataFrame) -> DataFrame:
    checked = F.col("matches_expectation").isNotNull()
    more = [_rate(F.sum("char_count"), F.count("*")).alias("avg_char_count"), F.count_if(checked).alias("expected_checked"), F.count_if("matches_expectation").alias("expected_matched"), F.count_if(~F.col("matches_expectation")).alias("unexpected_count")]
    out = records.agg(*measures(), *more)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("char_count_total", "table_count_total")})


def by(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(*measures())


def grouping_sets(records: DataFrame) -> DataFrame:
    """All records, suites and formats in one pass."""
    rows = records.withColumn("format", extension_or_none())
    sets = rows.groupingSets([["suite"], ["format"], []], "suite", "format")
    return sets.agg(F.grouping_id().cast("long").alias("level"), *measures()).select("level", "suite", "format", "total", "success", "failed", "char_count_total", "table_count_total", "success_rate_pct", "avg_processing_ms")


def first(records: DataFrame, n: int | None, order: list[Column], where: Column | None = None) -> DataFrame:
    """The first n, or all, in an order that leaves no ties."""
    rows = records if where is None else records.where(where)
    rows = rows.orderBy(*order)
    return rows if n is None else rows.limit(n)


def failed_cases(records: DataFrame, n: int = 20) -> DataFrame:
    return first(records, n, [F.col("ord")], ~F.col("success")).select("ord", "suite", "filename", one_line(F.col("error"), 120).alias("error"), "expected_success", "success")


def unexpected_cases(records: DataFrame, n: int | None = 20) -> DataFrame:
    return first(records, n, [F.col("ord")], F.col("matches_expectation") == F.lit(False)).select("ord", "suite", "filename", "expected_success", "success")


def slowest(records: DataFrame, n: int) -> DataFrame:
    how = F.coalesce(F.nullif("parse_method", F.lit("")), F.nullif("ocr_engine", F.lit("")), F.lit("-")).alias("method")
    return first(records, n, [F.desc("processing_ms"), F.col("ord")]).select("ord", "suite", "filename", "processing_ms", "char_count", how)


def counter(records: DataFrame, column: str) -> DataFrame:
    """Rows by value, where there is one."""
    return records.where(F.col(column) != "").groupBy(F.col(column).alias("key")).agg(F.count("*").alias("count"))


def error_counts(records: DataFrame) -> DataFrame:
    return records.where("not success and error_info is not null").groupBy(F.col("error_info.category").alias("category")).agg(F.count("*").alias("count"))


def error_samples(records: DataFrame, n: int = 8) -> DataFrame:
    rows = first(records, n, [F.col("ord")], ~F.col("success") & F.col("error_info").isNotNull())
    return rows.select("ord", "filename", "error_info.category", "error_info.message", "error_info.hint")


def health(summary: DataFrame) -> DataFrame:
    """The label of a summary: fine, usable or in need of attention."""
    fine = (F.col("failed") == 0) & (F.col("unexpected_count") == 0)
    usable = (F.col("failed") <= F.greatest(F.lit(1), F.floor(F.col("total") / 10))) & (F.col("unexpected_count") <= 1)
    rows = summary.withColumn("health", F.when(fine, "ok").when(usable, "warn").otherwise("danger"))
    return rows.select("health", F.element_at(F.create_map(*[F.lit(x) for x in ("ok", "状态稳定", "warn", "基本可用", "danger", "需要关注")]), F.col("health")).alias("label"))


def tone(rate: Column) -> Column:
    return F.when(rate >= 90, "ok").when(rate >= 70, "warn").otherwise("danger")


def bar_width(value: Column, most: Column) -> Column:
    return F.when(value <= 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(8.0), F.round(value / F.greatest(most, F.lit(1)) * 100, 2))))


def share_of_largest(groups: DataFrame, value: str) -> DataFrame:
    """Each group's share of the largest one's value, from one row that every task gets."""
    most = groups.agg(F.coalesce(F.max(value), F.lit(1)).alias("most"))
    return groups.crossJoin(F.broadcast(most))
