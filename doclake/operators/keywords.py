"""Keywords, word frequencies and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, STOPS, bind, strip

_ONE = "一"  # stands for all stops; its two bytes can't be the end of one CJK character and the start of the next
_PART = 1 << 21  # estimated bytes of texts a task


def _spread(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents by key over all tasks before they are blown up: a small file would be one task's work, and the terms of a large share would not fit a task's memory."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(size // _PART, 1 << 13) if size < 1 << 50 else 0  # a larger one says that it isn't known
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, parts)
    return docs.repartition(n, key)


def keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 15) -> DataFrame:
    """(key, rank, term, count): character n-grams met twice or more, most frequent first, then by place.

    The one exchange is of the texts, by key; counting and ranking then need no other. (An outer explode puts no filter below the
    exchange, so that whoever spreads the same texts can use it again.) Runs are cut into n-grams as UTF-16, where a place is found
    without reading what is before it; all from there to the counts is one stage of generated code.
    """
    marked = F.translate(F.col(text), STOPS, _ONE * len(STOPS))
    runs = _spread(docs, key, text).select(key, F.posexplode_outer(F.split(marked, rf"[^{CJK[1:-1]}]+", -1)).alias("no", "run")).where("length(run) >= 2")
    places = runs.select(key, F.col("no").cast("long").alias("no"), F.length("run").alias("size"), F.encode("run", "UTF-16BE").alias("run"))
    each = places.select("*", F.explode(F.sequence(F.lit(0), F.col("size") * 4 - 5)).alias("k"))  # start and length (from 2; the last of four isn't used)
    start, more = F.shiftright("k", 2), F.col("k").bitwiseAND(3)
    first = F.shiftleft("no", 34) + F.shiftleft(more.cast("long"), 32) + start  # run, length and start, in this order
    grams = each.where((more < 3) & (start + more + 2 <= F.col("size"))).select(key, F.substring("run", start * 2 + 1, more * 2 + 4).alias("term"), first.alias("first"))
    grams = grams.where(~F.contains("term", F.lit(_ONE.encode("utf-16-be"))))
    counts = grams.groupBy(key, "term").agg(F.count("*").alias("count"), F.min("first").alias("first")).where("count >= 2")
    return _ranked(counts, key, top).withColumn("term", F.decode("term", "UTF-16BE"))


def _ranked(counts: DataFrame, key: str, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select(key, F.col("rank").cast("long").alias("rank"), "term", F.col("count").cast("long").alias("count"))


def word_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 50) -> DataFrame:
    """(key, rank, term, count) of runs of two or more CJK or Latin letters."""
    found = _spread(docs, key, text).select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"([一-龥a-zA-Z]{2,})"), 1)).alias("first", "term"))
    return _ranked(found.groupBy(key, "term").agg(F.count("*").alias("count"), F.min("first").alias("first")), key, top)


def _weights(top: Column) -> Column:
    """Pairs among the keywords; one of equal characters, which may overlap itself, has a pattern that finds all its places."""
    def weight(w: Column) -> Column:
        one, two = F.substring(w["term"], 1, 1), F.substring(w["term"], 2, 1)
        return F.struct(w["term"].alias("term"), w["count"].alias("count"), F.when(one == two, F.concat(one, F.lit("(?="), two, F.lit(")"))).alias("twice"))

    return F.transform(F.filter(top, lambda w: (w["rank"] <= 20) & (F.length(w["term"]) == 2)), weight)


def _score(sentence: Column, weights: Column) -> Column:
    """Counts of the pairs at all their places, six times: as many bytes has a pair."""
    def places(w: Column) -> Column:
        taken = F.octet_length(sentence) - F.octet_length(F.replace(sentence, w["term"], F.lit("")))
        return F.when(w["twice"].isNull(), taken).otherwise(F.regexp_count(sentence, w["twice"]) * 6)

    return F.aggregate(weights, F.lit(0).cast("long"), lambda s, w: s + w["count"] * places(w))


def analysed(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 15, most: int = 5) -> DataFrame:
    """(key, keywords, summary): keywords with their counts, and the sentences whose character pairs are keywords most often, in their order.

    Documents without a key are left out. The join's other side reads the same exchange of the texts again.
    """
    docs = docs.where(F.col(key).isNotNull())  # as the join would on one side only, which then had an exchange of its own
    best = F.array_sort(F.collect_list(F.struct("rank", "term", "count")))
    ranked = keywords(docs, key, text, max(top, 20)).groupBy(key).agg(best.alias("top"))
    none = F.array().cast("array<struct<rank:bigint,term:string,count:bigint>>")
    sentences = F.filter(F.transform(F.split(F.col(text), "[。！？\n]", -1), strip), lambda s: F.length(s) > 10)
    both = _spread(docs, key, text).join(ranked, key, "left").select(key, F.col(text).alias("text"), sentences.alias("sentences"), F.coalesce("top", none).alias("top"))
    scored = bind(_weights(F.col("top")), lambda weights: F.transform("sentences", lambda s, i: F.struct((-_score(s, weights)).alias("k"), i.alias("i"), s.alias("s"))))
    picked = F.transform(F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
    summary = F.when(F.size("sentences") == 0, F.substring("text", 1, 200)).otherwise(F.concat(F.array_join(picked, "。"), F.lit("。")))
    words = F.transform(F.filter("top", lambda w: w["rank"] <= top), lambda w: F.struct(w["term"].alias("term"), w["count"].alias("count")))
    return both.select(key, words.alias("keywords"), summary.alias("summary"))


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 5) -> DataFrame:
    """(key, summary); see ``analysed``."""
    return analysed(docs, key, text, most=most).select(key, "summary")
