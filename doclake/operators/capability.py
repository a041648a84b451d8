"""What an installation can do: parts (id, type, label, install, optional, installed, available) and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDS = ("pdfplumber", "pymupdf", "pypdfium2", "numpy", "easyocr", "onnxruntime", "rapidocr", "pytesseract", "pillow", "python_docx", "openpyxl", "python_pptx", "soffice", "tesseract")


def status() -> Column:
    missing = F.when(F.col("optional"), "optional_missing").otherwise("missing")
    broken = F.when(F.col("installed"), "degraded").otherwise(missing)
    return F.when(F.col("available"), "ready").otherwise(broken)


def summary(parts: DataFrame) -> DataFrame:
    gone = ~F.col("available")
    critical, optional = F.count_if((F.col("type") == "python") & ~F.col("optional") & gone), F.count_if(F.col("optional") & gone)
    overall = F.when((critical == 0) & (optional == 0), "ready").when(critical == 0, "degraded").otherwise("missing")
    return parts.agg(overall.alias("overall_status"), F.count("*").alias("total_items"), F.count_if("available").alias("ready_count"), critical.alias("critical_missing"), optional.alias("optional_missing"))


def profiles(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(…by, profile, status): formats that can be read, can partly be or can't; one aggregation pivots the parts."""
    has = {i: F.coalesce(F.bool_or(F.when(F.col("id") == i, F.col("available"))), F.lit(False)) for i in IDS}
    ocr = (has["onnxruntime"] & has["rapidocr"]) | has["easyocr"] | (has["pytesseract"] & has["tesseract"])
    backup = has["pypdfium2"] & has["pillow"] & has["numpy"] & ocr
    choose = lambda c, other="missing": F.when(c, "ready").otherwise(other)
    rows = {
        "pdf": F.when(has["pdfplumber"] | has["pymupdf"], "ready").when(backup, "degraded").otherwise("missing"), "word": choose(has["python_docx"]), "excel": choose(has["openpyxl"]),
        "powerpoint": choose(has["python_pptx"]), "image_ocr": choose(ocr), "legacy_doc_fallback": choose(has["soffice"], "degraded"), "text_json_csv": F.lit("ready"),
    }
    by = by or []
    wide = parts.groupBy(*by).agg(*[c.alias(n) for n, c in rows.items()])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("profile"), F.col(n).alias("status")) for n in rows])))


def recommendations(parts: DataFrame, n: int = 8) -> DataFrame:
    """The first advice by ``ord``."""
    s = status()
    prefix = F.when(s == "degraded", "建议修复").when(s == "missing", "建议安装").otherwise("可选安装")
    return parts.where(s != "ready").orderBy("ord").limit(n).select("ord", F.concat(prefix, F.lit("："), "label", F.lit("（"), "install", F.lit("）")).alias("advice"))


def installed_now(wanted: DataFrame, after: DataFrame) -> DataFrame:
    """Wanted ids with what became of them."""
    now = F.coalesce("installed", F.lit(False))
    return wanted.join(after.select("id", "installed"), "id", "left").select("id", now.alias("installed"), F.when(now, "installed").otherwise("failed").alias("status"))


def first_known(preferred: Column, available: Column) -> Column:
    """Preferred entries that are available, in order; else the first available."""
    known = F.array_intersect(preferred, available)
    return F.when(F.size(known) > 0, known).otherwise(F.slice(available, 1, 1))
