"""python -m doclake FOLDER... [-f FORMAT] [-o FOLDER] [--no-keywords] [--pdf-mode MODE] [--report FOLDER]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import reports
from .operators.formats import FORMATS
from .functions.planning import DEFAULT_MODE, MODES
from .plans.process import process, records_of, write_files
from .sources.model import Options
from .sources.suites import resolve


def main() -> int:
    p = argparse.ArgumentParser(prog="doclake", description="Read folders of documents.")
    p.add_argument("folders", nargs="+")
    p.add_argument("--format", "-f", default="txt", choices=sorted(FORMATS))
    p.add_argument("-o", "--output")
    p.add_argument("--report")
    p.add_argument("--no-keywords", action="store_const", const=True)
    p.add_argument("--pdf-mode", default=DEFAULT_MODE, choices=MODES)
    a = p.parse_args()
    suites = resolve(a.folders)
    if not suites:
        p.error("no such folder")
    spark = SparkSession.builder.appName("doclake").getOrCreate()
    results = process(spark, suites, a.format, not a.no_keywords, options=Options(pdf_mode=a.pdf_mode))
    if a.report:
        records = records_of(results, spark.createDataFrame([], "suite string, filename string, expected_success boolean"))
        found = reports.gather(records)
        Path(a.report).mkdir(parents=True, exist_ok=True)
        Path(a.report, "report.md").write_text(reports.markdown(found), encoding="utf-8")
        Path(a.report, "summary.html").write_text(reports.html(found), encoding="utf-8")
        reports.write_json(records, a.report)
        reports.write_csv(records, a.report)
    rows = write_files(results, a.output, a.format) if a.output else ((r, "") for r in results.orderBy("suite_no", "path").toLocalIterator())
    for r, to in rows:
        if not r.success:
            print(f"[错误] {r.file_name}: {r.error}")
            continue
        print(f"✓ {r.file_name} → {to}" if to else f"{r.formatted}\n\n处理耗时: {r.processing_ms:.1f}ms")
        if not a.no_keywords and r.keywords:
            print("关键词: " + ", ".join(f"{k.term}({k['count']})" for k in r.keywords[:5]))
        if not a.no_keywords and r.summary:
            print(f"摘要: {r.summary[:100]}...")
    return 0


if __name__ == "__main__":
    sys.exit(main())
