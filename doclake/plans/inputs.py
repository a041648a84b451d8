"""Input tables of the queries, derived from the driver's tables in the same way for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import expected, with_errors

LATIN = "abcdefghijklmnopqrstuvwxyz."
CJK = "文档表格图像页面识别引擎数据分析处理结果质量的了和在。"
ERRORS = (
    "", "缺少依赖: pip install python-docx", "不支持的文件格式: .bin", "'utf-8' codec can't decode byte 0xff", "File is not a zip file", "OCR 引擎不可用",
    "文件不存在: a/b.txt", "Permission denied", "Expecting value:\nline 5", "No module named 'fitz'", "",
)
METHODS = ("pdfplumber", "", "逐页混合提取（文本层 + OCR）", "高分辨率 OCR", "")
ENGINES = ("", "Tesseract", "", "EasyOCR", "", "", "RapidOCR")
STATES = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("suite"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("filename"), F.concat(F.lit("."), "lang").alias("extension"), F.octet_length("text").cast("long").alias("size_bytes"), "text", "n_chars")


def cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, CJK).alias("text"))


def noised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the white space, control characters and noise that the tables lack."""
    i = F.col("doc_id")
    text = F.concat(
        F.when(i % 3 == 0, "\xa0 \t").otherwise(""), F.replace("text", F.lit(". "), F.lit("\n\n\n")), F.when(i % 5 == 0, " ____ �").otherwise(""),
        F.when(i % 4 == 0, " \u2028  \n\n\n\n HYPERLINK\r\n 42 \x0btail").otherwise(""), F.when(i % 7 == 0, "\x1c\x85\u3000").otherwise(""),
    )
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(files(spark, sf_dir).select("doc_id", "suite", "filename"), "doc_id")
    return rows.select("suite", "filename", (F.col("quality") == 1).alias("expected_success"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = files(spark, sf_dir).select(
        i.alias("ord"), "suite", "filename", F.concat("suite", F.lit("/"), "filename").alias("path"), F.when(i % 13 == 0, "").otherwise(F.col("extension")).alias("extension"), "size_bytes",
        (pick(ERRORS, i) == "").alias("success"), F.col("n_chars").alias("char_count"), (i % 4).alias("table_count"), ((F.col("n_chars") * 37 + i) % 100000 / 100.0).alias("processing_ms"),
        pick(METHODS, i).alias("parse_method"), pick(ENGINES, i).alias("ocr_engine"), pick(ERRORS, i).alias("error"),
    )
    return with_errors(expected(rows, expectations(spark, sf_dir), ["suite", "filename"]))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of suppliers as a table of cells for each nation, some null or padded."""
    s = read(spark, sf_dir, "supplier")
    pad = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" \t"), "s_name", F.lit("\xa0"))).otherwise(F.col("s_name"))
    row = F.array(pad, F.when(F.col("s_suppkey") % 4 == 0, F.lit(None)).otherwise(F.col("s_suppkey").cast("string")), F.lit('say "x", y'))
    blank = F.array(F.lit(""), F.lit(None).cast("string"), F.lit(""))
    rows = s.select(F.col("s_nationkey").cast("long").alias("doc_id"), "s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, blank).otherwise(row).alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", "row")))
    return rows.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["row"]).alias("table"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("event_type"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").when(F.col("event_type") == "view", "INFO").otherwise("TRACE")
    step = F.col("event_id") % 9 + 1
    line = F.concat(F.lit("["), level, F.lit("] ["), step.cast("string"), F.lit("/9] suite "), (F.col("user_id") % 3).cast("string"), F.lit(" -> file_"), F.col("event_id").cast("string"), F.lit(".txt"))
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", state.alias("state"), line.alias("line"), (F.col("value") - 50).alias("progress"), "value")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up installation for each nation."""
    from ..operators.capability import IDS

    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"))
    each = F.posexplode(F.array(*[F.lit(i) for i in IDS])).alias("ord", "id")
    k = (F.col("site") * 7 + F.col("ord") * 5) % 11
    rows = n.select("site", each)
    return rows.select(
        "site", F.col("ord").cast("long").alias("ord"), "id", F.when(F.col("id").isin("soffice", "tesseract"), "tool").otherwise("python").alias("type"), F.upper("id").alias("label"),
        F.concat(F.lit("pip install "), "id").alias("install"), (~F.col("id").isin("pdfplumber", "pillow", "python_docx", "openpyxl", "python_pptx")).alias("optional"), (k < 8).alias("installed"), (k < 6).alias("available"),
    )


# The same for DuckDB.

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_text(v: str) -> str:
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+$', '')"


def sql_lines(x: str) -> str:
    split = f"string_split_regex({x}, '{_ENDS}')"
    return f"(CASE WHEN ({split})[-1] = '' THEN list_slice({split}, 1, len({split}) - 1) ELSE {split} END)"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def sql_normalize(x: str) -> str:
    joined = f"array_to_string(list_transform({sql_lines(f'replace({x}, chr(0), chr(32))')}, lambda l: {sql_rstrip('l')}), chr(10))"
    return sql_strip(f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


FILES_SQL = """files AS (SELECT doc_id, source AS suite, 'doc_' || doc_id || '.' || lang AS filename, '.' || lang AS extension, strlen(text)::BIGINT AS size_bytes, text, n_chars FROM documents)"""
CJK_SQL = f"""cjk AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{CJK}') AS text FROM documents)"""
NOISED_SQL = """noised AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN chr(160) || ' ' || chr(9) ELSE '' END) || replace(text, '. ', chr(10) || chr(10) || chr(10))
  || (CASE WHEN doc_id % 5 = 0 THEN ' ____ ' || chr(65533) ELSE '' END)
  || (CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(8232) || '  ' || repeat(chr(10), 4) || ' HYPERLINK' || chr(13) || chr(10) || ' 42 ' || chr(11) || 'tail' ELSE '' END)
  || (CASE WHEN doc_id % 7 = 0 THEN chr(28) || chr(133) || chr(12288) ELSE '' END) AS text FROM documents)"""
NORMAL_SQL = f"{NOISED_SQL}, normal AS MATERIALIZED (SELECT doc_id, {sql_normalize('text')} AS text FROM noised)"
_CODE = {
    ERRORS[1]: "missing_dependency", ERRORS[2]: "unsupported_format", ERRORS[3]: "encoding_error", ERRORS[4]: "corrupt_file", ERRORS[5]: "ocr_unavailable",
    ERRORS[6]: "file_not_found", ERRORS[7]: "permission_error", ERRORS[8]: "parse_failure", ERRORS[9]: "missing_dependency",
}
_CATEGORY = ("", "依赖缺失", "格式不支持", "编码异常", "文件损坏", "OCR 不可用", "文件缺失", "权限不足", "解析失败", "依赖缺失", "")
RECORDS_SQL = f"""{FILES_SQL}, records AS (SELECT f.doc_id AS ord, suite, filename, suite || '/' || filename AS path, CASE WHEN f.doc_id % 13 = 0 THEN '' ELSE extension END AS extension, size_bytes,
  quality = 1 AS expected_success, ({sql_list(ERRORS)})[f.doc_id % 11 + 1] AS error, error = '' AS success, success = expected_success AS matches_expectation, n_chars AS char_count, f.doc_id % 4 AS table_count,
  ((n_chars * 37 + f.doc_id) % 100000) / 100.0::DOUBLE AS processing_ms, ({sql_list(METHODS)})[f.doc_id % 5 + 1] AS parse_method, ({sql_list(ENGINES)})[f.doc_id % 7 + 1] AS ocr_engine,
  ({sql_list(_CATEGORY)})[f.doc_id % 11 + 1] AS error_category FROM files f LEFT JOIN labels l USING (doc_id))"""
CELLS_SQL = """cells AS (SELECT s_nationkey::BIGINT AS doc_id, list(CASE WHEN s_suppkey % 5 = 0 THEN ['', NULL, ''] ELSE
  [CASE WHEN s_suppkey % 3 = 0 THEN ' ' || chr(9) || s_name || chr(160) ELSE s_name END, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey::VARCHAR END, 'say "x", y'] END ORDER BY s_suppkey) AS tab FROM supplier GROUP BY 1)"""
EVENTS_SQL = """ev AS (SELECT user_id AS job, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state,
  '[' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'TRACE' END || '] [' || (event_id % 9 + 1) || '/9] suite ' || (user_id % 3) || ' -> file_' || event_id || '.txt' AS line,
  value - 50 AS progress, value FROM events)"""
PARTS_SQL = """ids AS (SELECT unnest(['pdfplumber', 'pymupdf', 'pypdfium2', 'numpy', 'easyocr', 'onnxruntime', 'rapidocr', 'pytesseract', 'pillow', 'python_docx', 'openpyxl', 'python_pptx', 'soffice', 'tesseract']) AS id, unnest(range(14)) AS ord),
parts AS (SELECT n_nationkey::BIGINT AS site, ord, id, CASE WHEN id IN ('soffice', 'tesseract') THEN 'tool' ELSE 'python' END AS type, upper(id) AS label, 'pip install ' || id AS install,
  id NOT IN ('pdfplumber', 'pillow', 'python_docx', 'openpyxl', 'python_pptx') AS optional, (n_nationkey * 7 + ord * 5) % 11 < 8 AS installed, (n_nationkey * 7 + ord * 5) % 11 < 6 AS available FROM nation, ids)"""
