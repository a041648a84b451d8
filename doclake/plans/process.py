"""From folders to results: parsed, analysed, rendered, stored."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import classify
from ..functions.text import path_stem
from ..operators import formats, keywords
from ..operators.evaluation import evaluate
from ..operators.records import expected
from ..sources import read_documents
from ..sources.model import Options, Recognizer


def with_analysis(docs: DataFrame, key: str = "path") -> DataFrame:
    """Documents with keywords (array of term and count) and summary; null where there is no text."""
    docs = docs.withColumn("_doc", F.concat_ws("\n", *[c for c in ("suite", key) if c in docs.columns]))  # a folder of two suites has each path twice
    texts = docs.where("text <> ''").select("_doc", "text")
    return docs.join(keywords.analysed(texts, "_doc"), "_doc", "left").drop("_doc")


def process(spark: SparkSession, suites: dict[str, str], output: str = "txt", analyse: bool = True, ocr: Recognizer | None = None, options: Options = Options()) -> DataFrame:
    """One row for each file with its text, tables, statistics, time and ``formatted`` output. Files that failed have an error and class."""
    docs = read_documents(spark, suites, ocr, options)
    docs = docs.withColumn("formatted", formats.render(output))
    return with_analysis(docs) if analyse else docs


def records_of(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """Batch records of results; expectations are (suite, filename, expected_success). ``ord`` rises in the order of suites, then paths."""
    r = results.select(
        "suite_no", "suite", F.col("file_name").alias("filename"), "path", F.concat(F.lit("."), "file_type").alias("extension"), "size_bytes", "success",
        F.col("stats.char_count").alias("char_count"), F.col("stats.table_count").alias("table_count"), F.coalesce("processing_ms", F.lit(0.0)).alias("processing_ms"),
        "parse_method", F.coalesce(F.col("metadata")["ocr_engine"], F.lit("")).alias("ocr_engine"), "error",
    )
    r = r.withColumn("extension", F.when(F.col("extension") == ".", "").otherwise(F.col("extension")))
    r = expected(r, expectations, ["suite", "filename"])
    r = r.orderBy("suite_no", "path").withColumn("ord", F.monotonically_increasing_id()).drop("suite_no")  # slim rows, sorted by ranges
    return r.withColumn("error_info", classify(F.col("error"))).withColumn("error_category", F.coalesce("error_info.category", F.lit("")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rules of an evaluation manifest: a JSON object with items."""
    item = "struct<path:string,expected_success:boolean,min_char_count:bigint,must_contain:array<string>,must_not_contain:array<string>,notes:string>"
    rows = spark.read.schema(f"name string, description string, items array<{item}>").option("multiLine", True).json(path)
    return rows.select(F.inline("items"))


def evaluate_folder(spark: SparkSession, manifest: str, base: str, suites: dict[str, str], ocr: Recognizer | None = None) -> DataFrame:
    """Rules held against the files under ``base``, to which their paths are relative."""
    docs = read_documents(spark, suites, ocr)
    path = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(F.startswith(path, F.lit(base.rstrip("/") + "/")), F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.length(path))).otherwise(path)
    results = docs.select(relative.alias("path"), "success", F.col("stats.char_count").alias("char_count"), "text", "error", "processing_ms")
    return evaluate(read_manifest(spark, manifest), results)


def write_outputs(results: DataFrame, folder: str, output: str = "txt") -> None:
    """Formatted outputs as text, written by the tasks; a folder for each suite, document and <stem>_extracted.<ext>, so that equal stems don't meet."""
    name = F.concat(path_stem(F.col("path")), F.lit(f"_extracted.{formats.EXTENSIONS.get(output, 'txt')}"))
    results.select("suite", F.col("file_name").alias("document"), name.alias("file"), "formatted").write.mode("overwrite").partitionBy("suite", "document", "file").text(folder)


def write_files(results: DataFrame, folder: str, output: str = "txt") -> Iterator[tuple[Row, str]]:
    """The same as plain local files <stem>_extracted.<ext>, a row at a time; of equal names later ones take the document's own name in."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    suffix, used = formats.EXTENSIONS.get(output, "txt"), set()
    for r in results.orderBy("suite_no", "path").toLocalIterator():
        if r.success:
            stem, k = Path(r.file_name).stem, 1
            name = f"{stem}_extracted.{suffix}"
            while name in used:
                name, k = f"{r.file_name}{'' if k == 1 else f'_{k}'}_extracted.{suffix}", k + 1
            used.add(name)
            Path(folder, name).write_text(r.formatted, encoding="utf-8")
            yield r, str(Path(folder, name))
        else:
            yield r, ""


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Work inside can be stopped from another thread with ``cancel(spark, tag)``."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)


@contextmanager
def watched(spark: SparkSession, tell: Callable[[float, str], None], every: float = 0.5):
    """Calls ``tell`` (percent, message) with the share of tasks that are done in the stages seen so far; it never falls, and ends at 100."""
    tracker, ended, stages, most = spark.sparkContext.statusTracker(), threading.Event(), {}, 0.0
    before = set(tracker.getJobIdsForGroup(None))

    def look() -> None:
        nonlocal most
        for job in set(tracker.getJobIdsForGroup(None)) - before:
            for k in (found := tracker.getJobInfo(job)) and found.stageIds or ():
                if s := tracker.getStageInfo(k):
                    stages[k] = (s.numCompletedTasks, s.numTasks)
        done, whole = (sum(v[i] for v in stages.values()) for i in (0, 1))
        most = max(most, min(99.0, 100 * done / whole)) if whole else most
        tell(most, f"{done}/{whole}")

    def run() -> None:
        while not ended.wait(every):
            look()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
        look()
        tell(100.0, "done")
    finally:
        ended.set()
        thread.join()


def for_each_new(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str):
    """Run a batch function over every micro-batch of new files."""
    return stream.writeStream.foreachBatch(lambda df, _: handle(df)).option("checkpointLocation", checkpoint).start()
