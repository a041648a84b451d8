"""Results rendered as text, JSON, Markdown or CSV. Results have path, file_name, file_type, text, tables, metadata, stats, processing_ms, success, error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t
from ..functions.planning import engine_chain


def _ms() -> Column:
    return F.format_string("%.1fms", F.coalesce(F.col("processing_ms"), F.lit(0.0)).cast("double"))


def _all_tables(title: str, body: Callable[[Column], Column]) -> Column:
    each = F.transform("tables", lambda x, i: F.concat(F.lit(f"\n{title}表格 "), (i + 1).cast("string"), F.lit(":" if not title else ""), F.when(F.size(x) > 0, F.concat(F.lit("\n"), body(x))).otherwise("")))
    return F.array_join(each, "\n")


def to_txt() -> Column:
    rule = "═" * 60
    head = F.concat_ws("\n", F.lit("╔" + rule), F.concat(F.lit("║ 文件: "), "file_name"), F.concat(F.lit("║ 格式: "), F.upper("file_type"), F.lit("  |  耗时: "), _ms()), F.lit("╚" + rule), F.lit(""), F.lit("【文本内容】"), F.col("text"))
    some = F.when(F.size("tables") > 0, F.concat(F.lit("\n\n【表格数据】共 "), F.size("tables").cast("string"), F.lit(" 个表格\n"), _all_tables("", t.txt))).otherwise("")
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    meta = F.when(F.size("metadata") > 0, F.concat(F.lit("\n\n【元数据】\n"), F.array_join(pairs, "\n"))).otherwise("")
    return F.concat(head, some, meta)


def to_json() -> Column:
    """All of a result, indented: path, file_name, file_type, text, tables, metadata, stats, processing_ms, success, error."""
    return F.to_json(F.struct("path", "file_name", "file_type", "text", "tables", "metadata", "stats", "processing_ms", "success", "error"), {"pretty": "true", "ignoreNullFields": "false"})


def to_markdown() -> Column:
    head = F.concat_ws("\n", F.concat(F.lit("# 文档提取报告: "), "file_name"), F.lit(""), F.concat(F.lit("> 格式: `"), F.upper("file_type"), F.lit("` | 处理耗时: `"), _ms(), F.lit("`")), F.lit(""), F.lit("## 文本内容"), F.lit(""), F.col("text"))
    return F.concat(head, F.when(F.size("tables") > 0, F.concat(F.lit("\n\n## 表格数据\n"), _all_tables("### ", t.markdown))).otherwise(""))


def to_csv() -> Column:
    return t.csv(F.col("tables"))


FORMATS: dict[str, Callable[[], Column]] = {"txt": to_txt, "json": to_json, "markdown": to_markdown, "csv": to_csv}
#: Suffix of a format's files.
EXTENSIONS = {name: name for name in FORMATS} | {"markdown": "md"}


def render(name: str) -> Column:
    """The column of a format; unknown names give text."""
    return FORMATS.get(name, to_txt)()


def ocr_report() -> Column:
    """Labelled report of an image's recognition: file_name, engine, char_count, processing_ms, cache_hit, original_ms, order, attempted, notes, text."""
    ms = lambda c: F.format_string("%.0fms", F.col(c).cast("double"))
    notes = F.array_join(F.filter("notes", lambda n: F.trim(n) != ""), " | ")
    details = F.concat_ws(
        "\n", F.concat(F.lit("缓存命中: "), F.when(F.col("cache_hit"), "是").otherwise("否")), F.when(F.col("cache_hit") & F.col("original_ms").isNotNull(), F.concat(F.lit("原始OCR耗时: "), ms("original_ms"))),
        F.when(F.size("order") > 0, F.concat(F.lit("引擎顺序: "), engine_chain(F.col("order")))), F.when(F.size("attempted") > 0, F.concat(F.lit("尝试链路: "), engine_chain(F.col("attempted")))),
        F.when(notes != "", F.concat(F.lit("回退说明: "), notes)),
    )
    return F.concat_ws(
        "\n", F.concat(F.lit("[图片 OCR 结果] "), "file_name"), F.lit("━" * 40), F.concat(F.lit("OCR 引擎: "), "engine"), F.concat(F.lit("识别字符数: "), F.col("char_count").cast("string")),
        F.concat(F.lit("处理耗时: "), ms("processing_ms")), details, F.lit(""), F.lit("识别内容:"), F.lit("━" * 20), F.col("text"), F.lit(""),
    )
