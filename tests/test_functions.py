"""Column functions against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from doclake.functions import errors, planning, text
from doclake.operators import tables
from doclake.streaming.jobs import step

ODD = list("ab,.X9 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   \u3000文ß_=") + ["\r\n", "\n\n\n", "____"]


@pytest.fixture(scope="module")
def texts() -> list[str]:
    rng = random.Random(1)
    return ["", " ", "\n", "a\n"] + ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(600)]


def values(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def norm(t: str) -> str:
    return re.sub(r"\n\n\n+", "\n\n", "\n".join(x.rstrip() for x in t.replace("\0", " ").splitlines())).strip()


@pytest.mark.parametrize(
    ("column", "python"),
    [
        (lambda: text.strip(F.col("t")), str.strip),
        (lambda: text.lines(F.col("t")), str.splitlines),
        (lambda: text.words(F.col("t")), lambda t: len(t.split())),
        (lambda: text.normalize(F.col("t")), norm),
        (lambda: text.paragraphs(F.col("t"), "\n\n"), lambda t: len([p for p in t.split("\n\n") if p.strip()])),
        (lambda: text.tail(F.col("t"), 5), lambda t: t.strip()[-5:]),
    ],
)
def test_like_python(spark, texts, column, python):
    assert values(spark, texts, column()) == [python(t) for t in texts]


def test_normalize_is_idempotent(spark, texts):
    once = text.normalize(F.col("t"))
    assert values(spark, texts, once) == values(spark, texts, text.normalize(once))


def test_classes(spark):
    cases = {
        "": None, "  ": None, "缺少依赖: x": "missing_dependency", "No module named 'docx'": "missing_dependency", "unsupported thing": "unsupported_format",
        "cannot decode corrupt data": "encoding_error", "BadZipFile": "corrupt_file", "OCR 不可用": "ocr_unavailable", "ocr broke": "parse_failure",
        "No such file": "file_not_found", "权限不足": "permission_error", "Expecting value": "parse_failure",
    }
    got = values(spark, list(cases), errors.classify(F.col("t")))
    assert [g and g["code"] for g in got] == list(cases.values())
    hints = values(spark, ["PIP install Foo-bar.x now", "No module named PIL", "none"], errors.install_hint(F.col("t")))
    assert hints == ["PIP install Foo-bar.x", "pip install Pillow", ""]


def test_dispatch(spark):
    assert values(spark, [".PDF", "doc", ".tif", ".JPEG", ""], planning.dispatch(F.col("t"))) == ["pdf", "word", None, "image", None]


@pytest.mark.parametrize(("pages", "mb", "large", "huge"), [(31, 13.99, False, False), (32, 0.0, True, False), (1, 14.0, True, False), (89, 39.99, True, False), (90, 0.0, True, True), (1, 40.0, True, True)])
def test_plan_limits(spark, pages, mb, large, huge):
    plan = planning.pdf_plan(F.lit("accurate"), F.lit(pages), F.lit(mb), F.lit(True), F.lit(False))
    r = spark.range(1).select(*[c.alias(n) for n, c in plan.items()]).first()
    assert (r.is_large, r.is_huge, r.table_page_cap) == (large, huge, 24 if large else None)


def test_csv_rendering(spark):
    t = F.array(F.array(F.array(F.lit('a"b'), F.lit("c,d")), F.array(F.lit(""))), F.array(F.array(F.lit("x"))))
    assert spark.range(1).select(tables.csv(t)).first()[0] == '"a""b","c,d"\r\n""\r\n\r\nx\r\n\r\n'


def test_job_steps():
    assert step("queued", "cancel") == "cancelled"
    assert step("running", "cancel") == "cancelling"
    assert step("cancelling", "finish") == "cancelled"
    assert step("completed", "fail") == "completed"
