"""Folders to results and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from doclake.operators import cache, formats, reports
from doclake.operators import records as rec
from doclake.plans.process import evaluate_folder, process, records_of, watched, write_files, write_outputs
from doclake.sources.suites import resolve


def make(folder):
    folder.mkdir()
    (folder / "a.txt").write_text("文档处理文档处理文档处理。这是一句足够长的文档处理句子。")
    (folder / "b.csv").write_text("x,y\n1,2\n")
    (folder / "c.bin").write_bytes(b"?")


def test_process_and_report(spark, tmp_path):
    make(tmp_path / "in")
    results = process(spark, {"s": str(tmp_path / "in")}, "markdown")
    got = {r.file_name: r for r in results.collect()}
    assert got["a.txt"].keywords[0].term == "文档"
    assert got["a.txt"].summary.endswith("。")
    assert "| x | y |" in got["b.csv"].formatted
    assert got["c.bin"].error_info.code == "unsupported_format"
    expectations = spark.createDataFrame([("s", "a.txt", True), ("s", "b.csv", False)], "suite string, filename string, expected_success boolean")
    records = records_of(results, expectations)
    found = reports.gather(records)
    assert (found["all"][0]["total"], found["all"][0]["failed"], found["all"][0]["unexpected_count"]) == (3, 1, 1)
    assert "| s | c.bin |" in reports.markdown(found)
    assert "格式不支持" in reports.html(found)
    reports.write_json(records, str(tmp_path / "out"))
    reports.write_csv(records, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "results.csv")).count() == 3
    write_outputs(results, str(tmp_path / "texts"), "markdown")
    assert sorted(p.name for p in (tmp_path / "texts").glob("suite=s/document=*/file=*")) == ["file=a_extracted.md", "file=b_extracted.md", "file=c_extracted.md"]


def test_two_suites_over_one_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"f{k}.txt").write_text(f"text {k}")
    results = process(spark, {"b": str(tmp_path / "in"), "a": str(tmp_path / "in")})
    rows = results.collect()
    assert sorted((r.suite, r.file_name) for r in rows) == [(s, f"f{k}.txt") for s in "ab" for k in range(5)]
    assert all(r.processing_ms > 0 for r in rows)
    none = spark.createDataFrame([], "suite string, filename string, expected_success boolean")
    records = records_of(results, none).orderBy("ord").collect()
    assert [(r.suite, r.filename) for r in records] == [(s, f"f{k}.txt") for s in "ba" for k in range(5)]  # suites as given, then paths
    assert all(r.processing_ms > 0 for r in records)


def test_first_failed_in_input_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"f{k:02}.bin").write_text("x")
    none = spark.createDataFrame([], "suite string, filename string, expected_success boolean")
    records = records_of(process(spark, {"s": str(tmp_path / "in")}, analyse=False), none)
    assert [r.filename for r in rec.failed_cases(records).collect()] == [f"f{k:02}.bin" for k in range(20)]


def test_plain_files(spark, tmp_path):
    make(tmp_path / "in")
    (tmp_path / "in" / "a.md").write_text("# other")
    done = list(write_files(process(spark, {"s": str(tmp_path / "in")}, "json"), str(tmp_path / "out"), "json"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.txt_extracted.json", "a_extracted.json", "b_extracted.json"]
    assert [(r.file_name, bool(to)) for r, to in done] == [("a.md", True), ("a.txt", True), ("b.csv", True), ("c.bin", False)]
    whole = json.loads((tmp_path / "out" / "b_extracted.json").read_text())
    assert list(whole) == ["path", "file_name", "file_type", "text", "tables", "metadata", "stats", "processing_ms", "success", "error"]
    assert whole["tables"] == [[["x", "y"], ["1", "2"]]]
    assert whole["stats"]["table_count"] == 1


def test_report_read_back(spark, tmp_path):
    make(tmp_path / "in")
    expectations = spark.createDataFrame([("s", "b.csv", False)], "suite string, filename string, expected_success boolean")
    records = records_of(process(spark, {"s": str(tmp_path / "in")}, analyse=False), expectations)
    reports.write_json(records, str(tmp_path / "out"))
    summary, again, failed, unexpected = reports.read_json(spark, str(tmp_path / "out"))
    assert (summary["total"], summary["failed"]) == (3, 1)
    assert again.count() == 3
    assert [r.filename for r in failed.collect()] == ["c.bin"]
    assert [r.filename for r in unexpected.collect()] == ["b.csv"]


def test_progress(spark):
    seen = []
    with watched(spark, lambda pct, text: seen.append((pct, text)), 0.05):
        spark.range(1000, numPartitions=8).groupBy(F.col("id") % 3).count().collect()
    assert seen[-1] == (100.0, "done")
    assert [p for p, _ in seen] == sorted(p for p, _ in seen)
    assert seen[-2][0] > 50


def test_report_lists_all_unexpected_cases(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(60):
        (tmp_path / "in" / f"f{k:02}.txt").write_text("text")
    expectations = spark.createDataFrame([("s", f"f{k:02}.txt", False) for k in range(60)], "suite string, filename string, expected_success boolean")
    found = reports.gather(records_of(process(spark, {"s": str(tmp_path / "in")}, "markdown"), expectations))
    assert found["all"][0]["unexpected_count"] == 60
    part = reports.markdown(found).split("## 不符合预期")[1].split("## ")[0]
    assert [k for k in range(60) if f"| s | f{k:02}.txt | False | True |" not in part] == []
    assert reports.html(found).split("<h2>不符合预期</h2>")[1].split("<h2>")[0].count("<tr>") == 21


def test_evaluation(spark, tmp_path):
    make(tmp_path / "in")
    items = [{"path": "in/a.txt", "expected_success": True, "min_char_count": 5, "must_contain": ["文档"]}, {"path": "in/none.txt", "expected_success": True}, {"path": "in/c.bin", "expected_success": False}]
    (tmp_path / "m.json").write_text(json.dumps({"name": "n", "items": items}))
    held = evaluate_folder(spark, str(tmp_path / "m.json"), str(tmp_path), {"s": str(tmp_path / "in")})
    got = {r.path: r for r in held.collect()}
    assert {p: r.rule_passed for p, r in got.items()} == {"in/a.txt": True, "in/none.txt": False, "in/c.bin": True}
    assert got["in/none.txt"].error == "文件不存在: in/none.txt"
    summary = reports.write_evaluation(held, str(tmp_path / "report"), "n")
    assert (summary["total"], summary["passed"], summary["contains_checked"], summary["min_char_checked"]) == (3, 2, 1, 1)
    text = (tmp_path / "report" / "evaluation.md").read_text()
    assert "| in/none.txt | 未通过 | 否 |" in text
    assert "- `in/none.txt`：文件不存在: in/none.txt" in text
    whole = json.loads((tmp_path / "report" / "evaluation.json").read_text())
    assert [x["path"] for x in whole["items"]] == ["in/a.txt", "in/c.bin", "in/none.txt"]


def test_cache_round_trip(spark, tmp_path):
    wanted = spark.createDataFrame([("k1", "f1", 1.0), ("k2", "f2", 1.0)], "cache_key string, file_name string, elapsed_ms double")
    compute = lambda rows: rows.select("cache_key", "file_name", F.lit("t").alias("text"), F.lit("Tesseract").alias("engine"), F.lit(1).cast("long").alias("char_count"), F.lit(1).cast("long").alias("paragraph_count"), F.lit(9.0).alias("processing_ms"))
    none = spark.createDataFrame([], "cache_key string, text string, engine string, original_ms double, saved_at timestamp, version int")
    first = cache.through(wanted.where("cache_key = 'k1'"), none, compute)
    assert [r.cache_hit for r in first.collect()] == [False]
    cache.save(first, str(tmp_path / "cache"))
    again = {r.cache_key: r for r in cache.through(wanted, spark.read.parquet(str(tmp_path / "cache")), compute).collect()}
    assert (again["k1"].cache_hit, again["k1"].original_ms, again["k2"].cache_hit) == (True, 9.0, False)


def test_ocr_report(spark):
    r = spark.createDataFrame([("f.png", "RapidOCR", 2, 12.4, True, 30.0, ["rapidocr"], ["rapidocr", "x"], ["", "slow"], "ab")], "file_name string, engine string, char_count long, processing_ms double, cache_hit boolean, original_ms double, order array<string>, attempted array<string>, notes array<string>, text string")
    text = r.select(formats.ocr_report()).first()[0]
    assert text.splitlines()[:8] == ["[图片 OCR 结果] f.png", "━" * 40, "OCR 引擎: RapidOCR", "识别字符数: 2", "处理耗时: 12ms", "缓存命中: 是", "原始OCR耗时: 30ms", "引擎顺序: RapidOCR"]
    assert "尝试链路: RapidOCR -> x\n回退说明: slow\n\n识别内容:" in text


def test_suites(tmp_path):
    (tmp_path / "a").mkdir()
    assert resolve(["x", "a", "", "none"], {"x": str(tmp_path / "a")}, str(tmp_path)) == {"x": str(tmp_path / "a")}
