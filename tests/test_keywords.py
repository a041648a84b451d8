"""Keywords and summaries of odd texts against plain Python, and plans that hold at size."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from doclake.functions.text import STOPS
from doclake.operators import keywords

_draw = random.Random(3)
TEXTS = {
    1: "文档处理文档处理。文档的处理一文档，处理文档！哈哈哈哈哈，这是哈哈哈吧哈哈。" * 3,
    2: None, 3: "", 4: "latin only, no runs. " * 20, 5: "鿿㐀文档鿿文档\U00020000文档😀文档", 6: "的一的一的一的一", 7: "一丁丁一丁丁一七丁七丁",
    8: "".join(_draw.choice("文档表格图像。\n 的一x") for _ in range(3000)), 9: "".join(chr(_draw.randrange(0x4E00, 0x4E20)) for _ in range(2000)),
    10: "".join(_draw.choice("哈呵") for _ in range(40)) + "。" + "".join(_draw.choice("哈呵嘿\n") for _ in range(400)),
}


def expected(texts: list[str], top: int) -> list[tuple[str, int]]:
    count, first = defaultdict(int), {}
    for text in texts:
        for no, run in enumerate(re.findall("[一-龥]+", text or "")):
            for n in (2, 3, 4):
                for i in range(len(run) - n + 1):
                    if not set(term := run[i : i + n]) & set(STOPS):
                        count[term] += 1
                        first[term] = min(first.get(term, (no, n, i)), (no, n, i))
    return sorted(((t, c) for t, c in count.items() if c >= 2), key=lambda x: (-x[1], first[x[0]]))[:top]


def summary(text: str | None) -> str | None:
    if text is None:
        return None
    parts = [s for s in (p.strip() for p in re.split("[。！？\n]", text)) if len(s) > 10]
    weights = {t: c for t, c in expected([text], 20) if len(t) == 2}
    scores = [sum(weights.get(s[i : i + 2], 0) for i in range(len(s))) for s in parts]
    best = sorted(sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:5])
    return "。".join(parts[i] for i in best) + "。" if parts else text[:200]


def test_keywords_of_odd_texts(spark):
    rows = [*TEXTS.items(), (11, TEXTS[1]), (11, TEXTS[8]), (None, TEXTS[5]), (None, TEXTS[7])]
    got = defaultdict(list)
    for r in keywords.keywords(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.term, r["count"]))
    for key in {k for k, _ in rows}:
        assert got[key] == expected([t for k, t in rows if k == key], 15), key


def test_summaries_of_odd_texts(spark):
    got = dict(keywords.summaries(spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")).collect())
    assert got == {k: summary(t) for k, t in TEXTS.items()}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_patterns_and_lambdas(spark, sf):
    p = plan(keywords.keywords(spark.read.parquet(f"{sf}/documents.parquet")))
    assert "rlike" not in p.lower()
    assert "lambda" not in p


def test_pairs_are_picked_once_a_document(spark, sf):
    p = plan(keywords.summaries(spark.read.parquet(f"{sf}/documents.parquet")))
    assert "(octet_length(" in p  # sizes in place of characters counted for each sentence and pair
    assert p.count("twice") > 0


def test_a_task_has_a_bounded_share(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(keywords, "_PART", 10_000, raising=False)
    assert keywords._spread(docs, "doc_id", "text").rdd.getNumPartitions() > 8
    unknown = spark.createDataFrame([(1, "x")], "doc_id long, text string")  # a table whose size isn't known
    assert keywords._spread(unknown, "doc_id", "text").rdd.getNumPartitions() <= 8


@pytest.mark.parametrize("size", [50_000])
def test_one_long_run(spark, size):
    text = "文档表格图像" * (size // 6)
    rows = keywords.keywords(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r.term, r["count"]) for r in rows} == set(expected([text], 15))
