"""A content-addressed table of results: what is known is restored, only the rest is computed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, size

VERSION = 1
KEPT_ENGINES = ("Tesseract", "EasyOCR", "PaddleOCR", "RapidOCR")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def key(content_sha: Column, profile: Column | dict) -> Column:
    """Of a content hash and a profile, as JSON with sorted keys."""
    text = F.lit(json.dumps(profile, ensure_ascii=False, sort_keys=True)) if isinstance(profile, dict) else profile
    return F.sha2(F.concat(content_sha, F.lit("|"), text), 256)


def _valid(cache: DataFrame) -> DataFrame:
    """Rows of this version; of several under a key the newest, whichever text breaks a tie."""
    newest = F.max_by(F.struct("text", "engine", "original_ms"), F.struct("saved_at", "text")).alias("r")
    return cache.where(F.col("version") == VERSION).groupBy("cache_key").agg(newest).select("cache_key", "r.*")


def hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted rows (cache_key, file_name, elapsed_ms) whose result is known, restored under the new name and time."""
    r = wanted.join(_valid(cache), "cache_key")
    text = F.coalesce("text", F.lit(""))
    return r.select("cache_key", "file_name", text.alias("text"), "engine", F.length(text).cast("long").alias("char_count"), size(lines(text)).alias("paragraph_count"), F.col("elapsed_ms").alias("processing_ms"), "original_ms", F.lit(True).alias("cache_hit"))


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.where(F.col("version") == VERSION).select("cache_key"), "cache_key", "left_anti")


def save(results: DataFrame, path: str) -> None:
    """Append new results by real engines (cache_key, text, engine, original_ms)."""
    rows = results.where(F.col("engine").isin(*KEPT_ENGINES)).select("cache_key", "text", "engine", F.col("original_ms").cast("double"), F.current_timestamp().alias("saved_at"), F.lit(VERSION).alias("version"))
    rows.write.mode("append").parquet(path)


def through(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Known results and those that ``compute`` makes of the rest, in one table."""
    fresh = compute(misses(wanted, cache)).withColumn("cache_hit", F.lit(False)).withColumn("original_ms", F.col("processing_ms"))
    known = hits(wanted, cache)
    return known.unionByName(fresh.select(*known.columns))
