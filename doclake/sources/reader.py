"""Folders of files to the table of documents: bytes are decoded in Arrow batches, one file a row, all else is columns."""

from __future__ import annotations

import functools
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.errors import classify
from ..functions.planning import dispatch
from . import image, ole, ooxml, pdf, plain
from .model import Options, Parser, Recognizer

PARSERS: dict[str, Parser] = {"pdf": pdf.parse, "docx": ooxml.word, "doc": ole.parse, "xlsx": ooxml.excel, "xls": ooxml.excel, "pptx": ooxml.powerpoint}
PARSERS |= {s: plain.parse for s in ("txt", "md", "json", "csv")} | {s: image.parse for s in ("png", "jpg", "jpeg", "bmp", "tiff", "webp")}

_PARSED = (
    "suite string, suite_no int, path string, size_bytes long, sha256 string, text string, tables array<array<array<string>>>, pages array<struct<page:long,source:string,chars:long,tables:long,error:string>>, "
    "metadata map<string,string>, parse_method string, numbers array<double>, slides long, processing_ms double, error string"
)
DOCUMENT = "suite, suite_no, path, file_name, file_type, size_bytes, sha256, text, tables, pages, metadata, parse_method, stats, processing_ms, success, error, error_info"


def register(suffix: str, parser: Parser) -> None:
    """Add or replace the parser of a suffix, for tables read from then on."""
    PARSERS[suffix.lower().lstrip(".")] = parser


def _empty(spark: SparkSession, folder: str) -> DataFrame:
    """Files of no bytes, which the source leaves out; from the folder's listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [(s.getPath().toString(), 0, bytearray()) for s in listed if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith((".", "_"))]
    return spark.createDataFrame(names, "path string, length long, content binary")


def find_files(spark: SparkSession, suites: dict[str, str]) -> DataFrame:
    """(suite, suite_no, path, content, …) of the files right in each suite's folder, without its README; suites are numbered as given."""
    parts = []
    for no, (name, folder) in enumerate(suites.items()):
        rows = spark.read.format("binaryFile").load(folder)
        rows = rows.select("path", "length", "content").unionByName(_empty(spark, folder))
        parts.append(rows.where(F.lower(t.path_name(F.col("path"))) != "readme.md").select(F.lit(name).alias("suite"), F.lit(no).alias("suite_no"), "path", "length", "content"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_files(files: DataFrame, ocr: Recognizer | None = None, options: Options = Options()) -> DataFrame:
    """Rows (path, content, and the suite if they have one) parsed, with the time that took; a file that can't be read is a row with its error."""
    parsers = dict(PARSERS)
    if parsers["pdf"] is pdf.parse:
        parsers["pdf"] = functools.partial(pdf.parse, options=options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for suite, no, path, size, sha, data in zip(b["suite"], b["suite_no"], b["path"], b["size_bytes"], b["sha256"], b["content"], strict=True):
                began = time.perf_counter()
                name = path.rpartition("/")[2]
                suffix = name.rpartition(".")[2].lower() if "." in name.lstrip(".") else ""
                row = {"suite": suite, "suite_no": no, "path": path, "size_bytes": size, "sha256": sha, "pages": [], "metadata": {}, "tables": [], "text": "", "parse_method": "", "numbers": [], "slides": None, "error": ""}
                try:
                    if suffix not in parsers:
                        raise ValueError(f"不支持的文件格式: {'.' * bool(suffix)}{suffix}")
                    p = parsers[suffix](bytes(data), suffix, ocr)
                    pages = [{"page": x.page, "source": x.source, "chars": len(x.text), "tables": x.tables, "error": x.error} for x in p.pages]
                    row |= {"text": p.text, "tables": p.tables, "pages": pages, "metadata": p.metadata, "parse_method": p.method, "numbers": p.numbers, "slides": p.slides}
                except Exception as e:  # any parser's failure is the file's result
                    row["error"] = str(e) or type(e).__name__
                row["processing_ms"] = (time.perf_counter() - began) * 1000
                rows.append(row)
            out = pd.DataFrame(rows)
            out["slides"] = out["slides"].astype("Int64") if len(out) else out.get("slides")
            yield out

    own = ["suite", "suite_no"] if "suite" in files.columns else [F.lit("").alias("suite"), F.lit(0).alias("suite_no")]
    slim = files.select(*own, "path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return slim.mapInPandas(run, _PARSED)


def read_documents(spark: SparkSession, suites: dict[str, str], ocr: Recognizer | None = None, options: Options = Options()) -> DataFrame:
    """The table of documents (columns DOCUMENT) of some folders; a folder of two suites gives each its rows."""
    parsed = parse_files(find_files(spark, suites), ocr, options)
    text, n = F.col("text"), F.size("numbers")
    total = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x)
    some = lambda c: F.when(n > 0, c)
    by_line = F.lower(t.path_suffix(F.col("path"))).isin(".docx", ".doc")
    stats = F.struct(
        F.length(text).cast("long").alias("char_count"), F.when(by_line, t.paragraphs(text, "\n")).otherwise(t.paragraphs(text, "\n\n")).alias("paragraph_count"), t.size(F.col("tables")).alias("table_count"),
        t.size(t.lines(text)).alias("line_count"), t.words(text).alias("word_count"), F.col("slides").alias("slide_count"), some(n.cast("long")).alias("numeric_count"), some(total).alias("sum"),
        some(total / n).alias("avg"), F.array_max("numbers").alias("max"), F.array_min("numbers").alias("min"),
    )
    name = t.path_name(F.col("path"))
    kind = F.lower(F.regexp_replace(t.path_suffix(F.col("path")), r"^\.", ""))
    rows = parsed.withColumns({"file_name": name, "file_type": kind, "parser": dispatch(kind), "stats": stats, "success": F.col("error") == "", "error_info": classify(F.col("error"))})
    return rows.select(*[c.strip() for c in DOCUMENT.split(",")])
