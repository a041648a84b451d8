"""Reports on batch records as files: results as JSON and CSV, a Markdown and an HTML page. Of what grows with the records,
only the unexpected cases reach the driver whole, as report.md lists all of them."""

from __future__ import annotations

import json
from datetime import datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import records as rec
from .evaluation import summarize


def write_json(records: DataFrame, folder: str) -> None:
    """results.json: lines of records and one of their summary, each in a folder of its own, as the tasks write them."""
    records.write.mode("overwrite").json(f"{folder}/results.json/records")
    rec.batch_summary(records).write.mode("overwrite").json(f"{folder}/results.json/summary")


def read_json(spark: SparkSession, folder: str, records_shape: StructType | None = None) -> tuple[dict[str, object], DataFrame, DataFrame, DataFrame]:
    """A report read back: its summary, all records, the first 20 failed and the first 20 unexpected cases."""
    reader = spark.read.schema(records_shape) if records_shape else spark.read
    records = reader.json(f"{folder}/results.json/records")
    summary = spark.read.json(f"{folder}/results.json/summary").first()
    return summary.asDict() if summary else {}, records, rec.failed_cases(records, 20), rec.unexpected_cases(records, 20)


def write_evaluation(items: DataFrame, folder: str, name: str = "评价集", description: str = "--") -> dict[str, object]:
    """evaluation.json and evaluation.md of held rules (``evaluation.evaluate``); a manifest's rules are few, so the driver writes both."""
    summary = {"name": name, "generated_at": datetime.now().isoformat(timespec="seconds")} | summarize(items).first().asDict()
    rows = [r.asDict(recursive=True) for r in items.orderBy("path").collect()]
    Path(folder).mkdir(parents=True, exist_ok=True)
    payload = {"manifest": {"name": name, "description": description}, "summary": summary, "items": rows}
    Path(folder, "evaluation.json").write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")
    facts = {
        "生成时间": summary["generated_at"], "描述": description, "总样本": summary["total"], "通过": summary["passed"], "未通过": summary["failed"], "通过率": f"{summary['pass_rate_pct']}%",
        "成功状态匹配": f"{summary['success_match_count']}/{summary['total']}", "关键词包含规则": f"{summary['contains_passed']}/{summary['contains_checked']}",
        "最小字符规则": f"{summary['min_char_passed']}/{summary['min_char_checked']}", "平均耗时": f"{summary['avg_processing_ms']} ms",
    }
    verdict = lambda passed, held: "--" if not held and not passed else "是" if passed else "否"
    table = [
        [r["path"], "通过" if r["rule_passed"] else "未通过", verdict(r["success_match"], True), verdict(r["min_char_pass"], r["min_char_count"] is not None), verdict(r["contains_pass"], r["must_contain"]), r["processing_ms"], r.get("notes") or r.get("error_category") or ""]
        for r in rows
    ]
    parts = [f"# {name}", "\n".join(f"- {k}：{v}" for k, v in facts.items() if k in ("生成时间", "描述")), "## 总览", "\n".join(f"- {k}：{v}" for k, v in facts.items() if k not in ("生成时间", "描述"))]
    parts += ["## 明细", pipe_table(["文件", "结果", "成功匹配", "字符规则", "包含规则", "耗时(ms)", "备注"], table)]
    if missed := [f"- `{r['path']}`：{r['error'] or '规则未通过'}" for r in rows if not r["rule_passed"]]:
        parts += ["## 未通过样本", "\n".join(missed)]
    Path(folder, "evaluation.md").write_text("\n\n".join(parts) + "\n", encoding="utf-8")
    return summary


def write_csv(records: DataFrame, folder: str) -> None:
    records.select(*rec.CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(f"{folder}/results.csv")


def pipe_table(head: list[str], rows: list[list[object]], none: str = "无") -> str:
    if not rows:
        return none
    line = lambda r: "| " + " | ".join("" if v is None else str(v) for v in r) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def gather(records: DataFrame) -> dict[str, list]:
    """Everything a report shows: groups (suites and formats), all unexpected cases, and other lists of at most 50 rows."""
    sets = rec.grouping_sets(records).collect()
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "all": rows(rec.batch_summary(records)), "suites": sorted((r.asDict() for r in sets if r.level == 1), key=lambda r: r["suite"]),
        "formats": sorted((r.asDict() for r in sets if r.level == 2), key=lambda r: r["format"]), "failed": rows(rec.failed_cases(records, 50)),
        "unexpected": rows(rec.unexpected_cases(records, None)), "slowest": rows(rec.slowest(records, 12)), "errors": rows(rec.error_counts(records).orderBy(F.desc("count"), "category")),
        "samples": rows(rec.error_samples(records)), "health": rows(rec.health(rec.batch_summary(records))),
    }


def markdown(found: dict[str, list], title: str = "批量报告") -> str:
    total = found["all"][0]
    pick = lambda rows, *names: [[r[n] for n in names] for r in rows]
    parts = [
        f"# {title}", "## 总览", pipe_table(["指标", "值"], [[k, v] for k, v in total.items()]),
        "## 测试集", pipe_table("测试集 总数 成功 失败 平均耗时(ms)".split(), pick(found["suites"], "suite", "total", "success", "failed", "avg_processing_ms")),
        "## 格式", pipe_table("格式 总数 成功 失败 成功率 平均耗时(ms)".split(), pick(found["formats"], "format", "total", "success", "failed", "success_rate_pct", "avg_processing_ms")),
        "## 失败", pipe_table("测试集 文件 预期 实际 错误".split(), pick(found["failed"], "suite", "filename", "expected_success", "success", "error")),
        "## 不符合预期", pipe_table("测试集 文件 预期 实际".split(), pick(found["unexpected"], "suite", "filename", "expected_success", "success")),
        "## 最慢", pipe_table("测试集 文件 耗时(ms) 字符数 方式".split(), pick(found["slowest"][:10], "suite", "filename", "processing_ms", "char_count", "method")),
        "## 错误", pipe_table("类型 次数".split(), pick(found["errors"], "category", "count")),
    ]
    return "\n\n".join(parts) + "\n"


def html(found: dict[str, list], title: str = "批量报告") -> str:
    """One page; widths of bars follow ``records.bar_width``."""
    cell = lambda v: "-" if v in (None, "") else escape(str(v))
    table = lambda rows: "<p>-</p>" if not rows else "<table><tr>" + "".join(f"<th>{cell(k)}</th>" for k in rows[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"
    most = max([r["count"] for r in found["errors"]], default=1)
    bars = "".join(f'<div>{cell(r["category"])} {r["count"]}<div class="bar" style="width:{min(100.0, max(8.0, round(r["count"] / max(most, 1) * 100, 2)))}%"></div></div>' for r in found["errors"])
    health = found["health"][0]
    body = f'<h1>{escape(title)}</h1><p class="{health["health"]}">{health["label"]}</p>{table(found["all"])}'
    for name, key, n in (("测试集", "suites", None), ("格式", "formats", None), ("失败", "failed", 20), ("不符合预期", "unexpected", 20), ("最慢", "slowest", 12), ("样例", "samples", 6)):
        body += f"<h2>{name}</h2>{table(found[key][:n])}"
    return f'<!DOCTYPE html><html lang="zh"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>{body}<h2>错误</h2>{bars}</body></html>'
