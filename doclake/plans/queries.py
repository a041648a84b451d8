"""One query for each operator of the survey, over the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, planning, text
from ..operators import cache, capability, evaluation, jobs, keywords, tables
from ..operators import records as rec
from . import inputs as i
from .inputs import CELLS_SQL, CJK_SQL, EVENTS_SQL, FILES_SQL, NOISED_SQL, NORMAL_SQL, PARTS_SQL, RECORDS_SQL, sql_count, sql_lines, sql_list, sql_strip, sql_text
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

S = SparkSession
CJK_SQL_CLASS = r"[\x{4e00}-\x{9fff}]"
_MEASURES = """count(*)::BIGINT AS total, count_if(success)::BIGINT AS success, count_if(NOT success)::BIGINT AS failed, sum(char_count)::BIGINT AS char_count_total, sum(table_count)::BIGINT AS table_count_total,
  round(count_if(success) * 100 / count(*)::DOUBLE, 2) AS success_rate_pct, round(sum(round(processing_ms * 100)::BIGINT)::DOUBLE / 100.0 / count(*), 2) AS avg_processing_ms"""


# Keywords and summaries

_KEYS = rf"""{CJK_SQL}, runs AS (SELECT doc_id, unnest(r) AS run, unnest(range(len(r))) AS no FROM (SELECT doc_id, regexp_extract_all(text, '[\x{{4e00}}-\x{{9fa5}}]+') AS r FROM cjk)),
g AS (SELECT doc_id, no, n, s, substr(run, s, n) AS term FROM (SELECT *, unnest(range(1, length(run) - n + 2)) AS s FROM runs, (SELECT unnest([2, 3, 4]) AS n)) WHERE NOT regexp_matches(substr(run, s, n), '[{text.STOPS}]')),
c AS (SELECT doc_id, term, count(*) AS count, min((no, n, s)) AS first FROM g GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) AS rank, term, count FROM c)"""


@query(f"WITH {_KEYS} SELECT doc_id, rank::BIGINT AS rank, term, count::BIGINT AS count FROM k WHERE rank <= 15")
def keywords_topk(spark: S, d: str) -> DataFrame:
    return keywords.keywords(i.cjk(spark, d))


@query(r"""WITH w AS (SELECT doc_id, unnest(r) AS term, unnest(range(len(r))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\x{4e00}-\x{9fa5}a-zA-Z]{2,}') AS r FROM documents)),
c AS (SELECT doc_id, term, count(*) AS count, min(pos) AS first FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) AS rank FROM c)
SELECT doc_id, rank::BIGINT AS rank, term, count::BIGINT AS count FROM k WHERE rank <= 50""")
def word_frequency(spark: S, d: str) -> DataFrame:
    return keywords.word_frequency(i.read(spark, d, "documents"))


@query(f"""WITH {_KEYS}, s AS (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[。！？\\n]'), lambda p: {sql_strip('p')}), lambda p: length(p) > 10) AS x FROM cjk)),
b AS (SELECT doc_id, pos, substr(s, p, 2) AS term FROM (SELECT *, unnest(range(1, length(s))) AS p FROM s)),
v AS (SELECT b.doc_id, pos, sum(k.count) AS score FROM b JOIN k ON k.doc_id = b.doc_id AND k.term = b.term AND k.rank <= 20 GROUP BY ALL),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(score, 0) DESC, s.pos) AS r FROM s LEFT JOIN v USING (doc_id, pos)),
t AS (SELECT doc_id, string_agg(s, '。' ORDER BY pos) || '。' AS summary FROM o WHERE r <= 5 GROUP BY 1)
SELECT c.doc_id, coalesce(t.summary, substr(c.text, 1, 200)) AS summary FROM cjk c LEFT JOIN t USING (doc_id)""")
def extract_summary(spark: S, d: str) -> DataFrame:
    return keywords.summaries(i.cjk(spark, d))


# Text functions


@query(f"WITH {NORMAL_SQL} SELECT doc_id, text FROM normal")
def normalize_text(spark: S, d: str) -> DataFrame:
    return i.noised(spark, d).select("doc_id", text.normalize(F.col("text")).alias("text"))


_SIGNAL = sql_count("text", r"[\x{4e00}-\x{9fff}A-Za-z0-9]")


@query(f"WITH {NORMAL_SQL} SELECT doc_id, text <> '' AND ({_SIGNAL} >= 8 OR length(text) >= 20) AS meaningful, {_SIGNAL}::BIGINT AS signal FROM normal")
def meaningful_text(spark: S, d: str) -> DataFrame:
    t = i.noised(spark, d).select("doc_id", text.normalize(F.col("text")).alias("text"))
    return t.select("doc_id", text.meaningful(F.col("text"), 8).alias("meaningful"), text.signal(F.col("text")).alias("signal"))


def _score_sql(t: str) -> str:
    filled = f"len(list_filter({sql_lines(t)}, lambda l: {sql_strip('l')} <> ''))"
    return (
        rf"({sql_count(t, CJK_SQL_CLASS)} * 2.0::DOUBLE + {sql_count(t, '[A-Za-z]')} + {sql_count(t, r'\p{Nd}')} * 0.8::DOUBLE + {filled} * 3.0::DOUBLE"
        rf" - {sql_count(t, r'\x{fffd}')} * 15.0::DOUBLE - {sql_count(t, r'[_=~\-]{4,}')} * 10.0::DOUBLE)"
    )


@query(f"WITH {NORMAL_SQL} SELECT doc_id, CASE WHEN text <> '' THEN {_score_sql('text')} END AS score FROM normal")
def ocr_text_score(spark: S, d: str) -> DataFrame:
    t = i.noised(spark, d).select("doc_id", text.normalize(F.col("text")).alias("text"))
    return t.select("doc_id", text.ocr_score(F.col("text")).alias("score"))


_LEGACY = r"""translate(text, chr(13) || chr(11) || chr(12) || chr(7) || chr(160) || chr(19) || chr(20) || chr(21), chr(10) || chr(10) || chr(10) || chr(9) || ' ')"""
for _p, _r in ((r"[\x00-\x08\x0e-\x1f\x7f-\x{9f}]+", "''"), ("|".join(text.FIELD_WORDS), "' '"), (r"[ \t]{3,}", "'  '"), (r"\n[ \t]+", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
    _LEGACY = f"regexp_replace({_LEGACY}, '{_p}', {_r}, 'g')"


@query(f"WITH {NOISED_SQL} SELECT doc_id, {_LEGACY} AS text FROM noised")
def clean_legacy_text(spark: S, d: str) -> DataFrame:
    return i.noised(spark, d).select("doc_id", text.clean_legacy(F.col("text")).alias("text"))


@query(f"""WITH {NOISED_SQL}, l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')})) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM noised),
k AS (SELECT *, length(x) AS n, len(list_distinct(string_split(x, ''))) AS kinds, ({sql_count('x', r'[\x{4e00}-\x{9fff}]')} + {sql_count('x', '[a-zA-Z]')} + {sql_count('x', r'\p{Nd}')}) AS t FROM l WHERE x <> ''),
g AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS text FROM k WHERE NOT (kinds < n * 0.25 AND n > 10) AND (t / n::DOUBLE > 0.5 OR (n > 10 AND t / n::DOUBLE > 0.35)) GROUP BY 1)
SELECT d.doc_id, coalesce(g.text, '') AS text FROM documents d LEFT JOIN g USING (doc_id)""")
def line_quality_filter(spark: S, d: str) -> DataFrame:
    return i.noised(spark, d).select("doc_id", text.good_lines(F.col("text")).alias("text"))


def _paragraphs(by: str) -> str:
    return f"len(list_filter(string_split(text, {by}), lambda p: {sql_strip('p')} <> ''))::BIGINT"


@query(f"WITH {NOISED_SQL} SELECT doc_id, length(text)::BIGINT AS char_count, {_paragraphs('chr(10) || chr(10)')} AS paragraph_count, doc_id % 4 AS table_count, len({sql_lines('text')})::BIGINT AS line_count FROM noised")
def text_stats_pdf(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    return i.noised(spark, d).select("doc_id", F.length(t).cast("long").alias("char_count"), text.paragraphs(t, "\n\n").alias("paragraph_count"), (F.col("doc_id") % 4).alias("table_count"), text.size(text.lines(t)).alias("line_count"))


@query(f"WITH {NOISED_SQL} SELECT doc_id, length(text)::BIGINT AS char_count, {_paragraphs('chr(10)')} AS paragraph_count FROM noised")
def text_stats_word(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    return i.noised(spark, d).select("doc_id", F.length(t).cast("long").alias("char_count"), text.paragraphs(t, "\n").alias("paragraph_count"))


@query(rf"WITH {NOISED_SQL} SELECT doc_id, length(text)::BIGINT AS char_count, {sql_count('text', r'[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+')}::BIGINT AS word_count, len({sql_lines('text')})::BIGINT AS line_count FROM noised")
def text_stats_plain(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    return i.noised(spark, d).select("doc_id", F.length(t).cast("long").alias("char_count"), text.words(t).alias("word_count"), text.size(text.lines(t)).alias("line_count"))


@query(f"WITH {NOISED_SQL} SELECT doc_id, length(text)::BIGINT AS char_count, len({sql_lines('text')})::BIGINT AS paragraph_count, doc_id % 9 AS slide_count FROM noised")
def text_stats_image(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    return i.noised(spark, d).select("doc_id", F.length(t).cast("long").alias("char_count"), text.size(text.lines(t)).alias("paragraph_count"), (F.col("doc_id") % 9).alias("slide_count"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(10) || repeat('#', (doc_id % 6)::INT + 1) || ' ' || lang WHEN doc_id % 4 = 1 THEN chr(10) || '# ' || lang ELSE lang END AS text FROM documents")
def heading_prefix(spark: S, d: str) -> DataFrame:
    n = F.col("doc_id")
    style = F.when(n % 4 == 0, F.concat(F.lit("Heading "), (n % 6 + 1).cast("string"))).when(n % 4 == 1, "Heading Title").otherwise("Normal")
    return i.read(spark, d, "documents").select("doc_id", text.heading(style, F.col("lang")).alias("text"))


@query(f"SELECT doc_id, right({sql_strip('text')}, 1600) AS tail FROM documents")
def tail_text(spark: S, d: str) -> DataFrame:
    return i.read(spark, d, "documents").select("doc_id", text.tail(F.col("text"), 1600).alias("tail"))


@query(f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(len(l))), lambda z: z[2] = 0 OR z[1] <> l[z[2]]), lambda z: z[1]), chr(10)) AS text
FROM (SELECT doc_id, {sql_lines('text')} AS l FROM documents)""")
def collapse_adjacent(spark: S, d: str) -> DataFrame:
    return i.read(spark, d, "documents").select("doc_id", F.array_join(text.collapse_adjacent(text.lines(F.col("text"))), "\n").alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(url, '([^/]*)$', 1) SIMILAR TO '.+\.[^.]+' THEN regexp_extract(url, '(\.[^./]+)$', 1) ELSE '' END AS suffix,
CASE WHEN regexp_extract(url, '([^/]*)$', 1) SIMILAR TO '.+\.[^.]+' THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]+$', '') ELSE regexp_extract(url, '([^/]*)$', 1) END AS stem
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.tar.GZ' WHEN 1 THEN url || '/.hidden' WHEN 2 THEN url || '/a.b' ELSE url END AS url FROM pages)""")
def path_parts(spark: S, d: str) -> DataFrame:
    n = F.col("page_id") % 4
    p = F.concat("url", F.when(n == 0, ".tar.GZ").when(n == 1, "/.hidden").when(n == 2, "/a.b").otherwise(""))
    return i.read(spark, d, "pages").select("page_id", text.path_name(p).alias("name"), text.path_suffix(p).alias("suffix"), text.path_stem(p).alias("stem"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT) ELSE format('{:,.2f}', v) END AS shown FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice) ELSE l_extendedprice END AS v FROM lineitem)")
def fmt_number(spark: S, d: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") % 2 == 0, F.floor("l_extendedprice").cast("double")).otherwise(F.col("l_extendedprice"))
    return i.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.number(v).alias("shown"))


@query("""SELECT page_id, CASE WHEN h IS NULL OR h = '' THEN '-' ELSE replace(replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') END AS shown
FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE html END AS h FROM pages)""")
def html_escape(spark: S, d: str) -> DataFrame:
    h = F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 7 == 1, "").otherwise(F.col("html"))
    return i.read(spark, d, "pages").select("page_id", text.or_dash(h).alias("shown"))


# Sources and dispatch


@query(f"""WITH {FILES_SQL} SELECT suite, count(*)::BIGINT AS cases FROM files WHERE lower(CASE WHEN doc_id % 17 = 0 THEN 'ReadMe.md' ELSE filename END) <> 'readme.md' GROUP BY 1""")
def count_cases(spark: S, d: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 17 == 0, "ReadMe.md").otherwise(F.col("filename"))
    return i.files(spark, d).where(F.lower(name) != "readme.md").groupBy("suite").agg(F.count("*").alias("cases"))


_SUFFIXES = (".PDF", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".txt", ".md", ".json", ".csv", ".png", ".tiff", ".tif", ".bin", "")


@query(f"""SELECT doc_id, s AS suffix, CASE WHEN k = 'pdf' THEN 'pdf' WHEN k IN ('docx', 'doc') THEN 'word' WHEN k IN ('xlsx', 'xls') THEN 'excel' WHEN k = 'pptx' THEN 'powerpoint' WHEN k IN ('csv', 'json', 'md', 'txt') THEN 'text'
  WHEN k IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'webp') THEN 'image' END AS parser FROM (SELECT doc_id, s, lower(ltrim(s, '.')) AS k FROM (SELECT doc_id, ({sql_list(_SUFFIXES)})[doc_id % {len(_SUFFIXES)} + 1] AS s FROM documents))""")
def dispatch_parser(spark: S, d: str) -> DataFrame:
    s = i.pick(_SUFFIXES, F.col("doc_id"))
    return i.read(spark, d, "documents").select("doc_id", s.alias("suffix"), planning.dispatch(s).alias("parser"))


@query("""SELECT event_id, json_valid(j) AS valid, CASE WHEN json_valid(j) THEN lower(json_type(j)) END AS kind, CASE WHEN json_valid(j) THEN len(json_keys(j))::BIGINT END AS n_keys,
  CASE WHEN json_valid(j) THEN array_to_string(json_keys(j), ',') END AS keys FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{' || props ELSE props END AS j FROM events)""")
def json_profile(spark: S, d: str) -> DataFrame:
    j = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    v = F.try_parse_json(j)
    keys = F.when(v.isNotNull(), F.json_object_keys(j))
    kind = F.when(v.isNotNull(), F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise(F.lower(F.schema_of_variant(v))))
    return i.read(spark, d, "events").select("event_id", v.isNotNull().alias("valid"), kind.alias("kind"), F.when(v.isNotNull(), text.size(keys)).alias("n_keys"), F.array_join(keys, ",").alias("keys"))


@query(f"""WITH {FILES_SQL} SELECT suite, filename FROM (SELECT suite, filename FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT suite, filename FROM files WHERE doc_id % 2 = 0)""")
def union_suites(spark: S, d: str) -> DataFrame:
    f = i.files(spark, d)
    return f.where("doc_id % 3 = 0").select("suite", "filename").unionByName(f.where("doc_id % 2 = 0").select("suite", "filename"))


@query("SELECT doc_id, sha256(text) AS sha FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark: S, d: str) -> DataFrame:
    rows = i.read(spark, d, "documents").select("doc_id", cache.content_hash(F.col("text")).alias("sha"))
    return rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha")


# Planning


@query("SELECT event_id, coalesce(CASE WHEN m IN ('accurate', 'balanced', 'fast') THEN m END, 'balanced') AS mode FROM (SELECT event_id, lower(trim(([' FAST ', 'Accurate', 'balanced', 'turbo', '', NULL])[event_id % 6 + 1])) AS m FROM events)")
def normalize_mode(spark: S, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in (" FAST ", "Accurate", "balanced", "turbo", "", None)]), (F.col("event_id") % 6 + 1).cast("int"))
    return i.read(spark, d, "events").select("event_id", planning.mode(raw).alias("mode"))


_PLAN_IN = """p AS (SELECT l_orderkey, l_linenumber, (['accurate', 'balanced', 'fast'])[l_partkey % 3 + 1] AS mode, (l_partkey * 7) % 120 AS pages, ((l_suppkey * 13 + l_linenumber) % 500) / 10.0::DOUBLE AS mb, l_partkey % 5 <> 0 AS pp, l_suppkey % 4 <> 0 AS mu, l_linenumber = 7 AS nt FROM lineitem)"""
_PLAN_SQL = f"""{_PLAN_IN}, q AS (SELECT *, pages >= 32 OR mb >= 14 AS is_large, pages >= 90 OR mb >= 40 AS is_huge FROM p),
r AS (SELECT *, (mode = 'fast' AND pp) OR (is_large AND mode = 'balanced') OR ((is_huge OR nt) AND mode <> 'accurate') AS off, is_large AND mode <> 'accurate' AS small FROM q),
s AS (SELECT *, CASE WHEN off OR (is_large AND mode = 'fast') THEN 0 WHEN is_large AND mode = 'accurate' THEN CASE WHEN pp THEN 24 ELSE 0 END END::BIGINT AS table_page_cap, pp AND NOT off AS extract_tables FROM r)"""


@query(f"""WITH {_PLAN_SQL} SELECT l_orderkey, l_linenumber, is_large, is_huge, CASE WHEN mu AND (mode = 'fast' OR is_large) THEN 'pymupdf' WHEN pp THEN 'pdfplumber' WHEN mu THEN 'pymupdf' ELSE 'ocr' END AS engine, extract_tables, table_page_cap,
  CASE WHEN is_large THEN '大文件优化 / ' ELSE '' END || CASE mode WHEN 'accurate' THEN '高精度' WHEN 'balanced' THEN '平衡' ELSE '快速' END || CASE WHEN is_huge THEN '（超大文档）' ELSE '' END AS runtime_label,
  CASE mode WHEN 'accurate' THEN 6 WHEN 'balanced' THEN 8 ELSE 12 END::BIGINT AS min_signal, CASE mode WHEN 'accurate' THEN 1500 WHEN 'balanced' THEN CASE WHEN small THEN 1100 ELSE 1200 END ELSE CASE WHEN small THEN 920 ELSE 1000 END END::BIGINT AS target_edge,
  CASE mode WHEN 'accurate' THEN 1800 WHEN 'balanced' THEN CASE WHEN small THEN 1350 ELSE 1600 END ELSE CASE WHEN small THEN 1100 ELSE 1200 END END::BIGINT AS max_edge,
  CASE mode WHEN 'accurate' THEN 120 WHEN 'balanced' THEN CASE WHEN small THEN 72 ELSE 80 END ELSE CASE WHEN small THEN 55 ELSE 60 END END::BIGINT AS score_break,
  CASE mode WHEN 'accurate' THEN 95 WHEN 'balanced' THEN CASE WHEN small THEN 58 ELSE 70 END ELSE CASE WHEN small THEN 42 ELSE 48 END END::BIGINT AS variant_break, is_large OR mode = 'fast' AS fast_ocr,
  CASE WHEN NOT extract_tables THEN '已关闭（大文件优化）' WHEN table_page_cap IS NOT NULL AND table_page_cap <> 0 THEN '前 ' || table_page_cap || ' 页尝试提取表格' ELSE '全页尝试提取表格' END AS table_label FROM s""")
def pdf_plan(spark: S, d: str) -> DataFrame:
    return _plans(spark, d).drop("pages")


def _plans(spark: S, d: str) -> DataFrame:
    mode = F.element_at(F.array(*[F.lit(m) for m in planning.MODES]), (F.col("l_partkey") % 3 + 1).cast("int"))
    pages, mb = (F.col("l_partkey") * 7) % 120, (F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 500 / 10.0
    plan = planning.pdf_plan(mode, pages, mb, F.col("l_partkey") % 5 != 0, F.col("l_suppkey") % 4 != 0, F.col("l_linenumber") == 7)
    return i.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pages.alias("pages"), *[c.alias(n) for n, c in plan.items()])


@query(f"WITH {_PLAN_SQL} SELECT l_orderkey, l_linenumber, extract_tables AND coalesce(pages < table_page_cap, TRUE) AS tables FROM s")
def table_page_filter(spark: S, d: str) -> DataFrame:
    return _plans(spark, d).select("l_orderkey", "l_linenumber", planning.table_page(F.col("extract_tables"), F.col("table_page_cap"), F.col("pages")).alias("tables"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 37) % 4000 + 1 AS w, (p_partkey * 91) % 3000 + 1 AS h FROM part), e AS (SELECT *, greatest(w, h) AS e FROM p),
s AS (SELECT *, CASE WHEN e > 1600 THEN 1600 / e::DOUBLE WHEN e >= 1200 THEN 1.0 ELSE 1200 / e::DOUBLE END AS k, CASE WHEN e >= 2400 THEN 1280 ELSE 1600 END AS t FROM e)
SELECT p_partkey, greatest(1, floor(w * k))::BIGINT AS page_w, greatest(1, floor(h * k))::BIGINT AS page_h, CASE WHEN e <= t THEN w ELSE greatest(1, floor(w * (t / e::DOUBLE))) END::BIGINT AS image_w, CASE WHEN e <= t THEN h ELSE greatest(1, floor(h * (t / e::DOUBLE))) END::BIGINT AS image_h FROM s""")
def resize_plan(spark: S, d: str) -> DataFrame:
    w, h = F.col("p_partkey") * 37 % 4000 + 1, F.col("p_partkey") * 91 % 3000 + 1
    page, image = planning.fit(w, h, F.lit(1200), F.lit(1600)), planning.shrink(w, h, F.lit(1600), F.lit(2400), F.lit(1280))
    return i.read(spark, d, "part").select("p_partkey", page[0].alias("page_w"), page[1].alias("page_h"), image[0].alias("image_w"), image[1].alias("image_h"))


_ORDERS = (" RapidOCR, easyocr", "tesseract,bogus,paddleocr", "none", "", "easyocr,,tesseract , rapidocr")
_ORDER_SQL = f"""o AS (SELECT event_id, CASE WHEN len(k) > 0 THEN k ELSE ['rapidocr', 'tesseract', 'easyocr'] END AS k FROM (SELECT event_id, list_filter(list_transform(string_split(lower(trim(({sql_list(_ORDERS)})[event_id % 5 + 1])), ','), lambda x: trim(x)), lambda x: x IN ('rapidocr', 'paddleocr', 'tesseract', 'easyocr')) AS k FROM events))"""


@query(f"WITH {_ORDER_SQL} SELECT event_id, array_to_string(k, ',') AS engines FROM o")
def engine_order(spark: S, d: str) -> DataFrame:
    order = planning.engine_order(i.pick(_ORDERS, F.col("event_id")))
    return i.read(spark, d, "events").select("event_id", F.array_join(order, ",").alias("engines"))


@query(f"""WITH {_ORDER_SQL} SELECT event_id, array_to_string(list_transform(k, lambda x: CASE x WHEN 'rapidocr' THEN 'RapidOCR' WHEN 'paddleocr' THEN 'PaddleOCR' WHEN 'tesseract' THEN 'Tesseract' ELSE 'EasyOCR' END), ' -> ') AS chain,
  CASE WHEN list_position(k, 'tesseract') IS NULL OR list_position(k, 'tesseract') = 0 THEN '' ELSE coalesce(k[list_position(k, 'tesseract') + 1], '') END AS after_tesseract FROM o""")
def engine_chain(spark: S, d: str) -> DataFrame:
    order = planning.engine_order(i.pick(_ORDERS, F.col("event_id")))
    return i.read(spark, d, "events").select("event_id", planning.engine_chain(order).alias("chain"), planning.next_engine(order, F.lit(" Tesseract")).alias("after_tesseract"))


@query("SELECT event_id, concat_ws(' ', CASE WHEN event_id % 3 = 0 THEN '--dpi 300' END, CASE WHEN event_id % 14 > 0 THEN '--psm ' || event_id % 14 END, CASE WHEN event_id % 4 = 1 THEN '--oem 1' END) AS options FROM events")
def ocr_options(spark: S, d: str) -> DataFrame:
    n = F.col("event_id")
    return i.read(spark, d, "events").select("event_id", planning.ocr_options(F.when(n % 3 == 0, " --dpi 300 ").otherwise(""), n % 14, F.when(n % 4 == 1, " 1").otherwise("")).alias("options"))


@query("SELECT event_id, CASE WHEN v = '' THEN TRUE ELSE v IN ('1', 'true', 'yes', 'on') END AS flag FROM (SELECT event_id, coalesce(lower(trim(([' TRUE', '1', 'off', '', NULL, 'On ', '2'])[event_id % 7 + 1])), '') AS v FROM events)")
def env_flag(spark: S, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in (" TRUE", "1", "off", "", None, "On ", "2")]), (F.col("event_id") % 7 + 1).cast("int"))
    return i.read(spark, d, "events").select("event_id", planning.flag(raw, True).alias("flag"))


@query("SELECT event_id, round(least(greatest(value - 50, 0.0), 100.0), 2) AS progress, 10 + least(greatest(value - 50, 0.0), 100.0) * 0.74::DOUBLE AS whole FROM events")
def clamp_progress(spark: S, d: str) -> DataFrame:
    v = F.col("value") - 50
    return i.read(spark, d, "events").select("event_id", planning.clamp(v).alias("progress"), planning.parser_progress(v).alias("whole"))


@query("SELECT l_orderkey, l_linenumber, 10 + (l_linenumber - 1 + least(greatest(l_discount * 12, 0.0), 1.0)) / greatest(7, 1)::DOUBLE * 78 AS progress FROM lineitem")
def page_progress(spark: S, d: str) -> DataFrame:
    return i.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", planning.page_progress(F.col("l_linenumber") - 1, F.lit(7), F.col("l_discount") * 12).alias("progress"))


@query("SELECT ['de', 'fr'][1] AS first_choice, lang AS key, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE a[1:1] END, '+') AS chosen FROM (SELECT lang, a, list_filter(['fr', 'src3', 'src1'], lambda x: list_contains(a, x)) AS k FROM (SELECT lang, list(DISTINCT source ORDER BY source) AS a FROM documents WHERE doc_id % 7 <> 0 OR lang <> 'es' GROUP BY 1))")
def pick_languages(spark: S, d: str) -> DataFrame:
    rows = i.read(spark, d, "documents").where("doc_id % 7 <> 0 or lang <> 'es'").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("a"))
    chosen = capability.first_known(F.array(F.lit("fr"), F.lit("src3"), F.lit("src1")), F.col("a"))
    return rows.select(F.lit("de").alias("first_choice"), F.col("lang").alias("key"), F.array_join(chosen, "+").alias("chosen"))


# Records and reports


@query(f"WITH {RECORDS_SQL} SELECT ord, expected_success, success, matches_expectation FROM records")
def expectation_match(spark: S, d: str) -> DataFrame:
    return i.records(spark, d).select("ord", "expected_success", "success", "matches_expectation")


_HINTS = {
    1: "pip install python-docx", 2: errors.CLASSES["unsupported_format"][2], 3: errors.CLASSES["encoding_error"][2], 4: errors.CLASSES["corrupt_file"][2], 5: errors.CLASSES["ocr_unavailable"][2],
    6: errors.CLASSES["file_not_found"][2], 7: errors.CLASSES["permission_error"][2], 8: errors.DEFAULT[3], 9: "pip install PyMuPDF",
}
_CODES = ("", *[i._CODE[i.ERRORS[k]] for k in range(1, 10)], "")


@query(f"""WITH {RECORDS_SQL} SELECT ord, ({sql_list(_CODES)})[ord % 11 + 1] AS code, error_category AS category, ({sql_list(("", *_HINTS.values(), ""))})[ord % 11 + 1] AS hint, CASE WHEN ord % 11 IN (1, 9) THEN 'warning' ELSE 'error' END AS severity,
  CASE ord % 11 WHEN 1 THEN 'python-docx' WHEN 9 THEN 'fitz' ELSE '' END AS dependency FROM records WHERE error <> ''""")
def classify_error(spark: S, d: str) -> DataFrame:
    r = i.records(spark, d).where("error_info is not null")
    return r.select("ord", "error_info.code", "error_info.category", "error_info.hint", "error_info.severity", "error_info.dependency")


@query(f"""WITH {RECORDS_SQL} SELECT ord, CASE ord % 11 WHEN 1 THEN 'pip install python-docx' WHEN 9 THEN 'pip install PyMuPDF' ELSE '' END AS command FROM records""")
def install_hint(spark: S, d: str) -> DataFrame:
    return i.records(spark, d).select("ord", errors.install_hint(F.col("error")).alias("command"))


@query(f"""WITH {RECORDS_SQL} SELECT {_MEASURES}, round(sum(char_count)::DOUBLE / count(*), 2) AS avg_char_count, count(matches_expectation)::BIGINT AS expected_checked, count_if(matches_expectation)::BIGINT AS expected_matched, count_if(NOT matches_expectation)::BIGINT AS unexpected_count FROM records""")
def batch_summary(spark: S, d: str) -> DataFrame:
    return rec.batch_summary(i.records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT suite, {_MEASURES} FROM records GROUP BY 1")
def suite_summary(spark: S, d: str) -> DataFrame:
    return rec.by(i.records(spark, d), "suite")


@query(f"WITH {RECORDS_SQL} SELECT coalesce(nullif(extension, ''), '<none>') AS format, {_MEASURES} FROM records GROUP BY 1")
def format_summary(spark: S, d: str) -> DataFrame:
    return rec.by(i.records(spark, d).withColumn("format", rec.extension_or_none()), "format")


@query(f"WITH {RECORDS_SQL} SELECT grouping_id(suite, format)::BIGINT AS level, suite, format, {_MEASURES} FROM (SELECT *, coalesce(nullif(extension, ''), '<none>') AS format FROM records) GROUP BY GROUPING SETS ((suite), (format), ())")
def summary_grouping_sets(spark: S, d: str) -> DataFrame:
    return rec.grouping_sets(i.records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT count(matches_expectation)::BIGINT AS checked, count_if(matches_expectation)::BIGINT AS matched, count_if(NOT matches_expectation)::BIGINT AS unexpected, string_agg(filename, ',' ORDER BY ord) FILTER (NOT matches_expectation) AS files FROM records")
def expectation_summary(spark: S, d: str) -> DataFrame:
    m = F.col("matches_expectation")
    names = F.array_sort(F.collect_list(F.when(~m, F.struct("ord", "filename"))))
    return i.records(spark, d).agg(F.count(m).alias("checked"), F.count_if(m).alias("matched"), F.count_if(~m).alias("unexpected"), F.array_join(F.transform(names, lambda x: x["filename"]), ",").alias("files"))


@query(f"WITH {RECORDS_SQL} SELECT coalesce(nullif(extension, ''), '<none>') AS format, count(*)::BIGINT AS count FROM records GROUP BY 1 ORDER BY 1")
def format_counter(spark: S, d: str) -> DataFrame:
    return i.records(spark, d).groupBy(rec.extension_or_none().alias("format")).agg(F.count("*").alias("count")).orderBy("format")


@query(f"WITH {RECORDS_SQL} SELECT parse_method AS key, count(*)::BIGINT AS count FROM records WHERE parse_method <> '' GROUP BY 1")
def parse_method_counts(spark: S, d: str) -> DataFrame:
    return rec.counter(i.records(spark, d), "parse_method")


@query(f"WITH {RECORDS_SQL} SELECT ocr_engine AS key, count(*)::BIGINT AS count FROM records WHERE ocr_engine <> '' GROUP BY 1")
def ocr_engine_counts(spark: S, d: str) -> DataFrame:
    return rec.counter(i.records(spark, d), "ocr_engine")


@query(f"WITH {RECORDS_SQL} SELECT error_category AS category, count(*)::BIGINT AS count FROM records WHERE NOT success GROUP BY 1")
def error_category_counts(spark: S, d: str) -> DataFrame:
    return rec.error_counts(i.records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT ord, filename, error_category AS category, error AS message, ({sql_list(("", *_HINTS.values(), ""))})[ord % 11 + 1] AS hint FROM records WHERE NOT success ORDER BY ord LIMIT 8")
def error_samples(spark: S, d: str) -> DataFrame:
    return rec.error_samples(i.records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT ord, suite, filename, substr(replace(error, chr(10), ' '), 1, 120) AS error, expected_success, success FROM records WHERE NOT success ORDER BY ord LIMIT 20")
def failed_cases(spark: S, d: str) -> DataFrame:
    return rec.failed_cases(i.records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT ord, suite, filename, expected_success, success FROM records WHERE matches_expectation = FALSE ORDER BY ord LIMIT 20")
def unexpected_cases(spark: S, d: str) -> DataFrame:
    return rec.unexpected_cases(i.records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT ord, suite, filename, processing_ms, char_count, coalesce(nullif(parse_method, ''), nullif(ocr_engine, ''), '-') AS method FROM records ORDER BY processing_ms DESC, ord LIMIT 10")
def slowest_k(spark: S, d: str) -> DataFrame:
    return rec.slowest(i.records(spark, d), 10)


@query(f"WITH {RECORDS_SQL} SELECT {', '.join(rec.CSV_COLUMNS)} FROM records")
def results_csv(spark: S, d: str) -> DataFrame:
    return i.records(spark, d).select(*rec.CSV_COLUMNS)


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT count(*) AS total, count_if(NOT success) AS failed, count_if(NOT matches_expectation) AS unexpected FROM records)
SELECT h AS health, CASE h WHEN 'ok' THEN '状态稳定' WHEN 'warn' THEN '基本可用' ELSE '需要关注' END AS label FROM (SELECT CASE WHEN failed = 0 AND unexpected = 0 THEN 'ok' WHEN failed <= greatest(1, total // 10) AND unexpected <= 1 THEN 'warn' ELSE 'danger' END AS h FROM s)""")
def health_label(spark: S, d: str) -> DataFrame:
    return rec.health(rec.batch_summary(i.records(spark, d)))


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT error_category AS category, count(*) AS n FROM records WHERE NOT success GROUP BY 1) SELECT category, CASE WHEN n <= 0 THEN 0.0 ELSE least(100.0::DOUBLE, greatest(8.0::DOUBLE, round(n / greatest((SELECT max(n) FROM c), 1)::DOUBLE * 100, 2))) END AS width FROM c""")
def bar_width(spark: S, d: str) -> DataFrame:
    return rec.share_of_largest(rec.error_counts(i.records(spark, d)), "count").select("category", rec.bar_width(F.col("count"), F.col("most")).alias("width"))


@query(f"WITH {RECORDS_SQL}, s AS (SELECT suite, {_MEASURES} FROM records GROUP BY 1) SELECT suite, CASE WHEN success_rate_pct >= 90 THEN 'ok' WHEN success_rate_pct >= 70 THEN 'warn' ELSE 'danger' END AS tone FROM s")
def rate_tone(spark: S, d: str) -> DataFrame:
    return rec.by(i.records(spark, d), "suite").select("suite", rec.tone(F.col("success_rate_pct")).alias("tone"))


@query(f"WITH {RECORDS_SQL}, s AS (SELECT coalesce(nullif(extension, ''), '<none>') AS format, count(*) AS n FROM records GROUP BY 1) SELECT format, round(n / (SELECT max(n) FROM s)::DOUBLE * 100, 2) AS share FROM s")
def format_share(spark: S, d: str) -> DataFrame:
    rows = i.records(spark, d).groupBy(rec.extension_or_none().alias("format")).agg(F.count("*").alias("total"))
    return rec.share_of_largest(rows, "total").select("format", F.round(F.col("total") / F.col("most") * 100, 2).alias("share"))


# Evaluation

_EVAL = f"""{RECORDS_SQL}, e AS (SELECT path, expected_success, char_count, error, CASE WHEN r.ord % 9 = 0 THEN FALSE ELSE success END AS actual_success, CASE WHEN r.ord % 9 = 0 THEN '' ELSE {sql_strip('d.text')} END AS t, CASE WHEN r.ord % 9 = 0 THEN 0.0 ELSE processing_ms END AS processing_ms,
  CASE WHEN r.ord % 9 = 0 THEN 0 ELSE char_count END AS chars, CASE WHEN r.ord % 3 = 0 THEN 500 END AS least, CASE WHEN r.ord % 2 = 0 THEN ['THE', 'Der'] ELSE [] END AS must, CASE WHEN r.ord % 5 = 0 THEN ['###', 'Ñ'] ELSE [] END AS mustnt, r.ord FROM records r JOIN documents d ON d.doc_id = r.ord),
v AS (SELECT *, coalesce(actual_success = expected_success, TRUE) AS success_match, coalesce(chars >= least, TRUE) AS min_char_pass, len(list_filter(must, lambda x: contains(lower(t), lower(x)))) = len(must) AS contains_pass, len(list_filter(mustnt, lambda x: contains(lower(t), lower(x)))) = 0 AS excludes_pass FROM e),
w AS (SELECT *, success_match AND min_char_pass AND contains_pass AND excludes_pass AS rule_passed FROM v)"""


def _evaluated(spark: S, d: str) -> DataFrame:
    r = i.records(spark, d)
    k, none = F.col("ord"), F.array().cast("array<string>")
    rules = r.select("path", "expected_success", F.when(k % 3 == 0, F.lit(500).cast("long")).alias("min_char_count"), F.when(k % 2 == 0, F.array(F.lit("THE"), F.lit("Der"))).otherwise(none).alias("must_contain"), F.when(k % 5 == 0, F.array(F.lit("###"), F.lit("Ñ"))).otherwise(none).alias("must_not_contain"))
    texts = i.read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    results = r.where("ord % 9 <> 0").join(texts, "ord").select("path", "success", "char_count", "text", "error", "processing_ms")
    return evaluation.evaluate(rules, results)


@query(f"WITH {_EVAL} SELECT path, success_match, min_char_pass, contains_pass, excludes_pass, rule_passed, chars AS actual_char_count, CASE WHEN ord % 9 = 0 THEN '文件不存在: ' || path ELSE error END AS error FROM w")
def evaluate_rules(spark: S, d: str) -> DataFrame:
    return _evaluated(spark, d).select("path", "success_match", "min_char_pass", "contains_pass", "excludes_pass", "rule_passed", "actual_char_count", "error")


@query(f"""WITH {_EVAL} SELECT count(*)::BIGINT AS total, count_if(rule_passed)::BIGINT AS passed, count_if(NOT rule_passed)::BIGINT AS failed, round(count_if(rule_passed) * 100 / count(*)::DOUBLE, 2) AS pass_rate_pct, count_if(success_match)::BIGINT AS success_match_count,
  count_if(len(must) > 0)::BIGINT AS contains_checked, count_if(len(must) > 0 AND contains_pass)::BIGINT AS contains_passed, count(least)::BIGINT AS min_char_checked, count_if(least IS NOT NULL AND min_char_pass)::BIGINT AS min_char_passed,
  round(sum(round(processing_ms * 100)::BIGINT)::DOUBLE / 100.0 / count(*), 2) AS avg_processing_ms FROM w""")
def evaluation_summary(spark: S, d: str) -> DataFrame:
    return evaluation.summarize(_evaluated(spark, d))


# Tables and assembly

_CLEAN = f"clean AS (SELECT doc_id, list_transform(tab, lambda r: list_transform(r, lambda c: {sql_strip('''coalesce(c, '')''')})) AS tab FROM cells)"
_LONG = "SELECT doc_id, row_no, unnest(range(len(r))) AS col_no, unnest(r) AS cell FROM (SELECT doc_id, unnest(range(len({t}))) AS row_no, unnest({t}) AS r FROM {f})"


def _long(df: DataFrame, table: str) -> DataFrame:
    rows = df.select("doc_id", F.posexplode(table).alias("row_no", "r"))
    return rows.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.posexplode("r").alias("col_no", "cell")).withColumn("col_no", F.col("col_no").cast("long"))


@query(f"WITH {CELLS_SQL}, {_CLEAN} {_LONG.format(t='tab', f='clean')}")
def clean_cells(spark: S, d: str) -> DataFrame:
    return _long(i.cells(spark, d).select("doc_id", tables.clean(F.col("table")).alias("table")), "table")


@query(f"WITH {CELLS_SQL}, kept AS (SELECT doc_id, list_filter(tab, lambda r: len(list_filter(r, lambda c: coalesce(c, '') <> '')) > 0) AS tab FROM cells) {_LONG.format(t='tab', f='kept')}")
def drop_empty_rows(spark: S, d: str) -> DataFrame:
    return _long(i.cells(spark, d).select("doc_id", tables.filled_rows(F.col("table")).alias("table")), "table")


@query(f"""WITH {CELLS_SQL}, {_CLEAN} SELECT doc_id, chr(10) || '[工作表: n' || doc_id || ']' || coalesce(array_to_string(list_transform(list_filter(tab, lambda r: len(list_filter(r, lambda c: c <> '')) > 0), lambda r: chr(10) || array_to_string(r, chr(9))), ''), '') AS text FROM clean""")
def sheet_text(spark: S, d: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"))
    return i.cells(spark, d).select("doc_id", tables.sheet_text(name, tables.clean(F.col("table"))).alias("text"))


@query(f"""WITH {CELLS_SQL}, {_CLEAN} SELECT doc_id, '| ' || array_to_string(tab[1], ' | ') || ' |' || chr(10) || '|---|---|---|' || array_to_string(list_transform(tab[2:], lambda r: chr(10) || '| ' || array_to_string(r, ' | ') || ' |'), '') AS text FROM clean""")
def format_markdown_table(spark: S, d: str) -> DataFrame:
    return i.cells(spark, d).select("doc_id", tables.markdown(tables.clean(F.col("table"))).alias("text"))


@query(f"""WITH {CELLS_SQL}, {_CLEAN} SELECT doc_id, array_to_string(list_transform(tab, lambda r: array_to_string(list_transform(r, lambda c: CASE WHEN regexp_matches(c, '[",\\r\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',') || chr(13) || chr(10)), '') || chr(13) || chr(10) AS text FROM clean""")
def format_csv_table(spark: S, d: str) -> DataFrame:
    return i.cells(spark, d).select("doc_id", tables.csv(F.array(tables.clean(F.col("table")))).alias("text"))


@query(f"""WITH {CELLS_SQL}, {_CLEAN} SELECT doc_id, '╔' || repeat('═', 60) || chr(10) || '║ 文件: n' || doc_id || '.xlsx' || chr(10) || '║ 格式: XLSX  |  耗时: 0.0ms' || chr(10) || '╚' || repeat('═', 60) || chr(10) || chr(10) || '【文本内容】' || chr(10) || 'body'
  || chr(10) || chr(10) || '【表格数据】共 1 个表格' || chr(10) || chr(10) || '表格 1:' || array_to_string(list_transform(tab, lambda r: chr(10) || '  ' || array_to_string(r, ' | ')), '') || chr(10) || chr(10) || '【元数据】' || chr(10) || '  sheets: 1' AS text FROM clean""")
def format_txt(spark: S, d: str) -> DataFrame:
    from ..operators import formats

    return _results(spark, d).select("doc_id", formats.render("txt").alias("text"))


@query(f"""WITH {CELLS_SQL}, {_CLEAN} SELECT doc_id, 'n' || doc_id || '.xlsx' AS file_name, 'body' AS body, len(tab)::BIGINT AS n_rows, tab[1][3] AS cell FROM clean""")
def format_json(spark: S, d: str) -> DataFrame:
    from ..operators import formats

    j = _results(spark, d).select("doc_id", F.parse_json(formats.render("json")).alias("j"))
    get = lambda p, t: F.try_variant_get("j", p, t)
    return j.select("doc_id", get("$.file_name", "string").alias("file_name"), get("$.text", "string").alias("body"), text.size(get("$.tables[0]", "array<array<string>>")).alias("n_rows"), get("$.tables[0][0][2]", "string").alias("cell"))


def _results(spark: S, d: str) -> DataFrame:
    t = F.array(tables.clean(F.col("table")))
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".xlsx"))
    return i.cells(spark, d).select("doc_id", name.alias("file_name"), F.lit("xlsx").alias("file_type"), F.lit("body").alias("text"), t.alias("tables"), F.create_map(F.lit("sheets"), F.lit("1")).alias("metadata"), F.lit(0.0).alias("processing_ms"), name.alias("path"), F.struct(F.length(F.lit("body")).cast("long").alias("char_count")).alias("stats"), F.lit(True).alias("success"), F.lit("").alias("error"))


@query("SELECT l_suppkey, count(*)::BIGINT AS numeric_count, sum(v::DECIMAL(28,6))::DOUBLE AS sum, sum(v::DECIMAL(28,6))::DOUBLE / count(*) AS avg, max(v) AS max, min(v) AS min FROM (SELECT l_suppkey, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1")
def numeric_cell_stats(spark: S, d: str) -> DataFrame:
    rows = i.read(spark, d, "lineitem").select("l_suppkey", F.explode(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("num"))
    return tables.number_stats(rows, ["l_suppkey"])


@query(f"SELECT conv_id AS doc_id, {sql_strip('''string_agg('[第 ' || (turn + 1) || ' 页]' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)''')} AS text, count(*)::BIGINT AS parts FROM conversations GROUP BY 1")
def assemble_pages(spark: S, d: str) -> DataFrame:
    page = F.concat(F.lit("[第 "), (F.col("turn") + 1).cast("string"), F.lit(" 页]\n"), "text")
    out = tables.assemble(i.read(spark, d, "conversations"), "conv_id", "turn", page, "\n\n")
    return out.select(F.col("conv_id").alias("doc_id"), text.strip(F.col("text")).alias("text"), "parts")


@query(f"""SELECT conv_id, string_agg('[Slide ' || (turn + 1) || ']' || chr(10) || {sql_strip('text')} || CASE WHEN role = 'system' THEN chr(10) || chr(10) || '  [备注] ' || role ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS text, count(*)::BIGINT AS parts FROM conversations WHERE {sql_strip('text')} <> '' GROUP BY 1""")
def slide_text(spark: S, d: str) -> DataFrame:
    body = text.strip(F.col("text"))
    slide = F.concat(F.lit("[Slide "), (F.col("turn") + 1).cast("string"), F.lit("]\n"), body, F.when(F.col("role") == "system", F.concat(F.lit("\n\n  [备注] "), "role")).otherwise(""))
    return tables.assemble(i.read(spark, d, "conversations").where(body != ""), "conv_id", "turn", slide, "\n\n")


_PAGE_ROWS = "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'ocr' ELSE 'pdfplumber' END AS source, CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) END AS chars, (turn % 2)::BIGINT AS tables FROM conversations"
_ROLLED = f"SELECT conv_id, count_if(chars > 0 AND source <> 'ocr')::BIGINT AS text_pages, count_if(chars > 0 AND source = 'ocr')::BIGINT AS ocr_pages, count_if(tables > 0)::BIGINT AS table_pages FROM ({_PAGE_ROWS}) GROUP BY 1"


def _rolled(spark: S, d: str) -> DataFrame:
    turn = F.col("turn")
    rows = i.read(spark, d, "conversations").select("conv_id", F.when(turn % 3 == 1, "ocr").otherwise("pdfplumber").alias("source"), F.when(turn % 4 == 3, 0).otherwise(F.length("text")).alias("chars"), (turn % 2).alias("tables"))
    seen, ocr = F.col("chars") > 0, F.col("source") == "ocr"
    return rows.groupBy("conv_id").agg(F.count_if(seen & ~ocr).alias("text_pages"), F.count_if(seen & ocr).alias("ocr_pages"), F.count_if(F.col("tables") > 0).alias("table_pages"))


@query(_ROLLED)
def page_rollup(spark: S, d: str) -> DataFrame:
    return _rolled(spark, d)


@query(f"SELECT conv_id, CASE WHEN ocr_pages > 0 AND text_pages > 0 THEN '逐页混合提取（文本层 + OCR）' WHEN ocr_pages > 0 THEN '高分辨率 OCR' ELSE 'pdfplumber' END AS method FROM ({_ROLLED})")
def parse_method(spark: S, d: str) -> DataFrame:
    return _rolled(spark, d).select("conv_id", planning.parse_method(F.col("text_pages"), F.col("ocr_pages"), F.lit("pdfplumber")).alias("method"))


@query(f"""WITH s AS (SELECT conv_id, turn, {_score_sql('t')} AS score FROM (SELECT conv_id, turn, {i.sql_normalize('text')} AS t FROM conversations) WHERE t <> ''),
c AS (SELECT *, min(CASE WHEN score >= 300 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM c WHERE stop IS NULL OR turn <= stop)
SELECT conv_id, turn AS best, score FROM b WHERE n = 1""")
def best_candidate(spark: S, d: str) -> DataFrame:
    """The best scored candidate of those tried until one scores enough."""
    from pyspark.sql import Window

    rows = i.read(spark, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("text")).where("text <> ''").select("conv_id", "turn", text.ocr_score(F.col("text")).alias("score"))
    rows = rows.withColumn("stop", F.min(F.when(F.col("score") >= 300, F.col("turn"))).over(Window.partitionBy("conv_id"))).where("stop is null or turn <= stop")
    best = F.max_by("turn", F.struct("score", -F.col("turn")))
    return rows.groupBy("conv_id").agg(best.alias("best"), F.max("score").alias("score"))


@query(f"""WITH p AS (SELECT conv_id, turn, {i.sql_normalize('text')} AS a, CASE WHEN turn % 2 = 0 THEN 'x' ELSE {i.sql_normalize('text')} END AS b FROM conversations), m AS (SELECT *, a <> '' AND ({sql_count('a', r'[\x{4e00}-\x{9fff}A-Za-z0-9]')} >= 8 OR length(a) >= 20) AND turn % 3 <> 0 AS ga, b <> '' AND ({sql_count('b', r'[\x{4e00}-\x{9fff}A-Za-z0-9]')} >= 8 OR length(b) >= 20) AS gb FROM p)
SELECT conv_id, turn, CASE WHEN ga THEN 'primary' WHEN gb THEN 'alternate' ELSE 'ocr' END AS engine, CASE WHEN ga THEN length(a) WHEN gb THEN length(b) ELSE 0 END::BIGINT AS chars FROM m""")
def page_engine_choice(spark: S, d: str) -> DataFrame:
    c = i.read(spark, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("t"))
    a = c.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("t")).otherwise("").alias("a"))
    b = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "x").otherwise(F.col("t")).alias("b"))
    both = a.join(b, ["conv_id", "turn"], "full")
    good = {k: text.meaningful(F.coalesce(k, F.lit("")), 8) for k in ("a", "b")}
    return both.select("conv_id", "turn", F.when(good["a"], "primary").when(good["b"], "alternate").otherwise("ocr").alias("engine"), F.when(good["a"], F.length("a")).when(good["b"], F.length("b")).otherwise(0).cast("long").alias("chars"))


@query(f"WITH {CELLS_SQL}, {_CLEAN}, u AS (SELECT doc_id, unnest(tab) AS r, unnest(range(len(tab))) AS pos FROM clean), f AS (SELECT doc_id, r, min(pos) AS pos FROM u GROUP BY 1, 2) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS row_no, array_to_string(r, '|') AS row FROM f")
def distinct_rows(spark: S, d: str) -> DataFrame:
    rows = i.cells(spark, d).select("doc_id", F.posexplode(F.array_distinct(tables.clean(F.col("table")))).alias("row_no", "r"))
    return rows.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("r", "|").alias("row"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS number FROM conversations")
def number_items(spark: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    return i.read(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("number"))


# Jobs


@query(f"WITH {EVENTS_SQL} SELECT job, seq, CASE WHEN line LIKE '[ERROR]%' THEN 'ERROR' WHEN line LIKE '[WARNING]%' THEN 'WARN' ELSE 'INFO' END AS level FROM ev")
def log_level(spark: S, d: str) -> DataFrame:
    return i.events(spark, d).select("job", "seq", text.log_level(F.col("line")).alias("level"))


@query(f"WITH {EVENTS_SQL} SELECT job, seq, seq % 9 + 1 AS index, 9::BIGINT AS total, 'suite ' || (job % 3) AS suite, 'file_' || seq || '.txt' AS file, greatest(0, seq % 9) AS completed FROM ev")
def parse_progress(spark: S, d: str) -> DataFrame:
    return jobs.parse_progress(i.events(spark, d)).select("job", "seq", "index", "total", "suite", "file", "completed")


@query(f"WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS log_id, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS back FROM ev) SELECT job, seq, log_id::BIGINT AS log_id FROM o WHERE back <= 40")
def job_log(spark: S, d: str) -> DataFrame:
    return jobs.log(i.events(spark, d), 40).select("job", "seq", "log_id")


@query(f"WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS back, count(*) OVER (PARTITION BY job) AS n FROM ev) SELECT job, state, round(least(greatest(progress, 0.0), 100.0), 2) AS progress, n::BIGINT AS events FROM o WHERE back = 1")
def latest_job_state(spark: S, d: str) -> DataFrame:
    return jobs.latest(i.events(spark, d))


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS back FROM ev), j AS (SELECT job, state, CASE WHEN job % 10 = 0 THEN 0 ELSE 9 END AS total, seq % 9 AS done FROM o WHERE back = 1),
k AS (SELECT job, state, total, CASE WHEN state = 'completed' AND total > 0 THEN total ELSE done END AS completed FROM j) SELECT job, state, total::BIGINT AS total, completed::BIGINT AS completed, CASE WHEN total > 0 THEN round(completed * 100 / total::DOUBLE, 2) ELSE 0.0 END AS progress_pct FROM k""")
def job_progress(spark: S, d: str) -> DataFrame:
    last = i.events(spark, d).groupBy("job").agg(F.max_by(F.struct("state", "seq"), F.struct("ts", "seq")).alias("e"))
    total = F.when(F.col("job") % 10 == 0, 0).otherwise(9).cast("long")
    return jobs.progress(last.select("job", "e.state", total.alias("total"), (F.col("e.seq") % 9).alias("completed")))


# Cache

_PROFILE = {"order": ["rapidocr", "tesseract"], "max_long_edge": 1600, "version": 1}
_KEY = """sha256(sha256(text) || '|' || '{"max_long_edge": 1600, "order": ["rapidocr", "tesseract"], "version": 1}')"""


def _wanted(spark: S, d: str) -> DataFrame:
    rows = i.read(spark, d, "documents").select("doc_id", "text", cache.key(cache.content_hash(F.col("text")), _PROFILE).alias("cache_key"))
    return rows.withColumns({"file_name": F.concat(F.lit("f"), F.col("doc_id").cast("string")), "elapsed_ms": F.lit(1.5)})


def _cached(spark: S, d: str) -> DataFrame:
    rows = _wanted(spark, d).where("doc_id % 2 = 0")
    return rows.select("cache_key", "text", F.lit("Tesseract").alias("engine"), F.lit(20.0).alias("original_ms"), F.col("doc_id").alias("saved_at"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(cache.VERSION).alias("version"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark: S, d: str) -> DataFrame:
    return i.read(spark, d, "documents").select("doc_id", cache.content_hash(F.col("text")).alias("sha"))


@query(f"SELECT doc_id, {_KEY} AS cache_key FROM documents")
def cache_key(spark: S, d: str) -> DataFrame:
    return _wanted(spark, d).select("doc_id", "cache_key")


@query(f"WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0) SELECT 'f' || doc_id AS file_name, length(text)::BIGINT AS char_count, len({sql_lines('text')})::BIGINT AS paragraph_count, 'Tesseract' AS engine, 1.5::DOUBLE AS processing_ms, 20.0::DOUBLE AS original_ms FROM documents WHERE text IN (FROM c)")
def cache_hits(spark: S, d: str) -> DataFrame:
    return cache.hits(_wanted(spark, d).drop("text"), _cached(spark, d)).select("file_name", "char_count", "paragraph_count", "engine", "processing_ms", "original_ms")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0)")
def cache_misses(spark: S, d: str) -> DataFrame:
    return cache.misses(_wanted(spark, d), _cached(spark, d)).select("doc_id")


@query("SELECT name, fresh FROM (SELECT 'r' || o_orderkey AS name, o_orderdate AS pos, o_orderkey % 50 <> 0 AS fresh, row_number() OVER (ORDER BY o_orderkey % 50 <> 0 DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def new_reports(spark: S, d: str) -> DataFrame:
    """The newest report that wasn't there before; failing that, the newest."""
    after = i.read(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("at"), "o_orderkey")
    before = after.where("o_orderkey % 50 = 0").select("name")
    fresh = after.join(before, "name", "left_anti").withColumn("fresh", F.lit(True))
    old = after.join(before, "name", "left_semi").withColumn("fresh", F.lit(False))
    return fresh.unionByName(old).orderBy(F.desc("fresh"), F.desc("at"), F.desc("o_orderkey")).limit(1).select("name", "fresh")


# Capabilities


@query(f"""WITH {PARTS_SQL} SELECT CASE WHEN c = 0 AND o = 0 THEN 'ready' WHEN c = 0 THEN 'degraded' ELSE 'missing' END AS overall_status, n AS total_items, r AS ready_count, c AS critical_missing, o AS optional_missing
FROM (SELECT count(*)::BIGINT AS n, count_if(available)::BIGINT AS r, count_if(type = 'python' AND NOT optional AND NOT available)::BIGINT AS c, count_if(optional AND NOT available)::BIGINT AS o FROM parts)""")
def capability_summary(spark: S, d: str) -> DataFrame:
    return capability.summary(i.parts(spark, d))


_H = ", ".join(f"bool_or(available AND id = '{x}') AS {x}" for x in capability.IDS)


@query(f"""WITH {PARTS_SQL}, h AS (SELECT site, {_H} FROM parts GROUP BY 1), o AS (SELECT *, (onnxruntime AND rapidocr) OR easyocr OR (pytesseract AND tesseract) AS ocr FROM h),
w AS (SELECT site, unnest(['pdf', 'word', 'excel', 'powerpoint', 'image_ocr', 'legacy_doc_fallback', 'text_json_csv']) AS profile, unnest([CASE WHEN pdfplumber OR pymupdf THEN 'ready' WHEN pypdfium2 AND pillow AND numpy AND ocr THEN 'degraded' ELSE 'missing' END,
  if(python_docx, 'ready', 'missing'), if(openpyxl, 'ready', 'missing'), if(python_pptx, 'ready', 'missing'), if(ocr, 'ready', 'missing'), if(soffice, 'ready', 'degraded'), 'ready']) AS status FROM o) SELECT * FROM w""")
def capability_profiles(spark: S, d: str) -> DataFrame:
    return capability.profiles(i.parts(spark, d), ["site"])


@query(f"""WITH {PARTS_SQL} SELECT ord, CASE WHEN installed THEN '建议修复' WHEN optional THEN '可选安装' ELSE '建议安装' END || '：' || label || '（' || install || '）' AS advice FROM parts WHERE site = 3 AND NOT available ORDER BY ord LIMIT 8""")
def recommendations(spark: S, d: str) -> DataFrame:
    return capability.recommendations(i.parts(spark, d).where("site = 3"))


@query(f"""WITH {PARTS_SQL} SELECT w.id, coalesce(p.installed, FALSE) AS installed, if(coalesce(p.installed, FALSE), 'installed', 'failed') AS status FROM (SELECT id FROM parts WHERE site = 0 UNION ALL SELECT 'nothing') w LEFT JOIN (SELECT * FROM parts WHERE site = 4 AND ord % 3 <> 0) p USING (id)""")
def install_status(spark: S, d: str) -> DataFrame:
    p = i.parts(spark, d)
    wanted = p.where("site = 0").select("id").unionByName(spark.range(1).select(F.lit("nothing").alias("id")))
    return capability.installed_now(wanted, p.where("site = 4 and ord % 3 <> 0"))
