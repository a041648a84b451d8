"""Properties that hold on any data, and plans that are as they should be."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from doclake.functions import text
from doclake.operators import jobs, keywords
from doclake.operators import records as rec
from doclake.plans import inputs
from doclake.plans.process import cancel, cancellable
from doclake.plans.queries import QUERIES
from doclake.streaming.jobs import step


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_add_up(spark, sf):
    r = inputs.records(spark, sf)
    total = rec.batch_summary(r).first()
    for column in ("suite", "extension"):
        sums = rec.by(r, column).agg(F.sum("total"), F.sum("success"), F.sum("char_count_total")).first()
        assert tuple(sums) == (total.total, total.success, total.char_count_total)


def test_keywords_are_frequent_and_ranked(spark, sf):
    rows = keywords.keywords(inputs.cjk(spark, sf)).collect()
    assert min(r["count"] for r in rows) >= 2
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r["rank"], -r["count"]))
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda x: x[1]) for v in by.values())


def test_summary_sentences_come_from_the_text(spark, sf):
    docs = {r.doc_id: r.text for r in inputs.cjk(spark, sf).collect()}
    for r in keywords.summaries(inputs.cjk(spark, sf)).collect():
        assert all(s in docs[r.doc_id] for s in r.summary.split("。"))


def test_no_records_give_zeroes(spark, sf):
    r = rec.batch_summary(inputs.records(spark, sf).where("false")).first()
    assert (r.total, r.success_rate_pct, r.avg_processing_ms, r.char_count_total) == (0, 0.0, 0.0, 0)


def test_batch_and_stream_machines_agree(spark):
    states = ["queued", "running", "cancelling", "completed", "failed", "cancelled"]
    actions = ["start", "finish", "fail", "cancel", "stop", "other"]
    rows = [(s, a) for s in states for a in actions]
    got = spark.createDataFrame(rows, "s string, a string").select("s", "a", jobs.next_state(F.col("s"), F.col("a")).alias("n")).collect()
    assert all(r.n == step(r.s, r.a) for r in got)


def test_keywords_exchange_once(spark, sf):
    assert plan(keywords.keywords(inputs.cjk(spark, sf))).count("Exchange hashpartitioning") == 1


def test_scans_read_only_what_they_need(spark, sf):
    p = plan(QUERIES["fmt_number"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in p
    p = plan(inputs.read(spark, sf, "documents").where("doc_id > 5").select("lang"))
    assert "GreaterThan(doc_id,5)" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_python(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert not re.search("EvalPython|InPandas|InArrow|pythonUDF|CartesianProduct", p)


def test_cancelling(spark):
    with cancellable(spark, "work"):
        assert spark.range(3).count() == 3
    assert cancel(spark, "work") == []


def test_html_escape(spark):
    t = spark.createDataFrame([("<a b='\"&'>",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(text.or_dash(F.col("t"))).collect()] == ["&lt;a b=&#x27;&quot;&amp;&#x27;&gt;", "-", "-"]
