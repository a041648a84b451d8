"""How a document would be processed: parser, PDF plan, image size, OCR engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Parsers in order; the first that takes a suffix has it. Images go past them to OCR.
PARSERS = {"pdf": ("pdf",), "word": ("docx", "doc"), "excel": ("xlsx", "xls"), "powerpoint": ("pptx",), "text": ("txt", "md", "json", "csv")}
IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff", "webp")
MODES = ("accurate", "balanced", "fast")
DEFAULT_MODE = "balanced"
ENGINES = {name.lower(): name for name in "RapidOCR PaddleOCR Tesseract EasyOCR".split()}
ENGINE_ORDER = ("rapidocr", "tesseract", "easyocr")
LABELS = {"accurate": "高精度", "balanced": "平衡", "fast": "快速"}
#: By mode: least signal, long edges aimed at and allowed, scores that end the search over pages and variants.
BASE = {"accurate": (6, 1500, 1800, 120, 95), "balanced": (8, 1200, 1600, 80, 70), "fast": (12, 1000, 1200, 60, 48)}
LARGE = {"balanced": (8, 1100, 1350, 72, 58), "fast": (12, 920, 1100, 55, 42)}


def dispatch(suffix: Column) -> Column:
    """Parser of a suffix with or without its dot; null for none."""
    s = F.lower(F.regexp_replace(suffix, r"^\.", ""))
    out = F.when(s.isin(*IMAGES), "image")
    for name, kinds in PARSERS.items():
        out = out.when(s.isin(*kinds), name)
    return out


def mode(value: Column) -> Column:
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*MODES), v).otherwise(DEFAULT_MODE)


def _by_mode(mode: Column, table: dict[str, tuple[int, ...]], k: int) -> Column:
    out = F.lit(None).cast("long")
    for name, values in table.items():
        out = F.when(mode == name, F.lit(values[k]).cast("long")).otherwise(out)
    return out


def pdf_plan(mode: Column, pages: Column, size_mb: Column, plumber: Column, mupdf: Column, no_tables: Column | None = None) -> dict[str, Column]:
    """Columns of the plan for a PDF of that size with those engines; ``no_tables`` is the switch against tables."""
    large = (pages >= 32) | (size_mb >= 14)
    huge = (pages >= 90) | (size_mb >= 40)
    no_tables = F.lit(False) if no_tables is None else no_tables
    first = F.when(plumber, "pdfplumber").when(mupdf, "pymupdf").otherwise("ocr")
    engine = F.when(mupdf & ((mode == "fast") | large | huge), "pymupdf").otherwise(first)
    off = (mode == "fast") & plumber | large & (mode == "balanced") | huge & (mode != "accurate") | no_tables & (mode != "accurate")
    cap = F.when(off | large & (mode == "fast"), 0).when(large & (mode == "accurate"), F.when(plumber, 24).otherwise(0)).cast("long")
    tables = plumber & ~off
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), mode)
    label = F.when(large, F.concat(F.lit("大文件优化 / "), label)).otherwise(label)
    shrunk = large & (mode != "accurate")
    edge = lambda k: F.when(shrunk, _by_mode(mode, LARGE, k)).otherwise(_by_mode(mode, BASE, k))
    shown = F.when(~tables, "已关闭（大文件优化）").when(cap.isNotNull() & (cap != 0), F.concat(F.lit("前 "), cap.cast("string"), F.lit(" 页尝试提取表格"))).otherwise("全页尝试提取表格")
    return {
        "is_large": large, "is_huge": huge, "engine": engine, "extract_tables": tables, "table_page_cap": cap,
        "runtime_label": F.when(huge, F.concat(label, F.lit("（超大文档）"))).otherwise(label), "min_signal": edge(0), "target_edge": edge(1),
        "max_edge": edge(2), "score_break": edge(3), "variant_break": edge(4), "fast_ocr": large | (mode == "fast"), "table_label": shown,
    }


def pdf_plan_of(mode: str, pages: int, size_mb: float, plumber: bool, mupdf: bool, no_tables: bool = False) -> dict[str, object]:
    """``pdf_plan`` for one document, where a parser needs it; a test holds the two against each other."""
    large, huge = pages >= 32 or size_mb >= 14, pages >= 90 or size_mb >= 40
    engine = "pymupdf" if mupdf and (mode == "fast" or large or huge) else "pdfplumber" if plumber else "pymupdf" if mupdf else "ocr"
    off = (mode == "fast" and plumber) or (large and mode == "balanced") or (huge and mode != "accurate") or (no_tables and mode != "accurate")
    cap = 0 if off or (large and mode == "fast") else (24 if plumber else 0) if large and mode == "accurate" else None
    tables = plumber and not off
    label = ("大文件优化 / " if large else "") + LABELS[mode]
    sizes = LARGE[mode] if large and mode in LARGE else BASE[mode]
    shown = "已关闭（大文件优化）" if not tables else f"前 {cap} 页尝试提取表格" if cap else "全页尝试提取表格"
    return {
        "is_large": large, "is_huge": huge, "engine": engine, "extract_tables": tables, "table_page_cap": cap, "runtime_label": label + "（超大文档）" * huge,
        **dict(zip(("min_signal", "target_edge", "max_edge", "score_break", "variant_break"), sizes, strict=True)), "fast_ocr": large or mode == "fast", "table_label": shown,
    }


def table_page(extract: Column, cap: Column, page_index: Column) -> Column:
    return extract & F.coalesce(page_index < cap, F.lit(True))


def _scaled(width: Column, height: Column, edge: Column, to: Column) -> tuple[Column, Column]:
    scale = to / F.greatest(edge, F.lit(1))
    return tuple(F.greatest(F.lit(1), F.floor(v * scale)).cast("long") for v in (width, height))


def fit(width: Column, height: Column, target: Column, most: Column) -> tuple[Column, Column]:
    """Size for OCR of a page: long edge brought into target..most."""
    edge = F.greatest(width, height)
    down, up = _scaled(width, height, edge, most), _scaled(width, height, edge, target)
    return tuple(F.when(edge > most, d).when(edge >= target, v.cast("long")).otherwise(u) for v, d, u in zip((width, height), down, up, strict=True))


def shrink(width: Column, height: Column, most: Column, trigger: Column, huge: Column) -> tuple[Column, Column]:
    """Size for OCR of an image: very large ones go to ``huge``, others to ``most``, never enlarged."""
    edge = F.greatest(width, height)
    to = F.when(edge >= trigger, huge).otherwise(most)
    small = _scaled(width, height, edge, to)
    return tuple(F.when(edge <= to, v.cast("long")).otherwise(s) for v, s in zip((width, height), small, strict=True))


def engine_order(raw: Column) -> Column:
    named = F.transform(F.split(F.lower(strip(raw)), ","), strip)
    known = F.filter(named, lambda x: x.isin(*ENGINES))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*[F.lit(x) for x in ENGINE_ORDER]))


def next_engine(order: Column, current: Column) -> Column:
    """The one after ``current``; empty if there is none."""
    at = F.array_position(order, F.lower(strip(current)))
    return F.when(at == 0, "").otherwise(F.coalesce(F.get(order, at.cast("int")), F.lit("")))


def engine_label(name: Column) -> Column:
    n = strip(name)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENGINES.items() for x in kv]), F.lower(n)), F.nullif(n, F.lit("")), F.lit("未知引擎"))


def engine_chain(names: Column) -> Column:
    return F.array_join(F.transform(F.filter(names, lambda x: strip(x) != ""), engine_label), " -> ")


def ocr_options(base: Column, psm: Column, oem: Column) -> Column:
    given = lambda c, p: F.when(strip(c) != "", F.concat(F.lit(p), strip(c)))
    return F.concat_ws(" ", F.nullif(strip(base), F.lit("")), F.when(psm > 0, F.concat(F.lit("--psm "), psm.cast("string"))), given(oem, "--oem "))


def flag(value: Column, default: bool = False) -> Column:
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(v == "", default).otherwise(v.isin("1", "true", "yes", "on"))


def parse_method(text_pages: Column, ocr_pages: Column, engine: Column) -> Column:
    both = (ocr_pages > 0) & (text_pages > 0)
    return F.when(both, "逐页混合提取（文本层 + OCR）").when(ocr_pages > 0, "高分辨率 OCR").otherwise(engine)


def clamp(value: Column) -> Column:
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), 2)


def parser_progress(value: Column) -> Column:
    """A parser's percentage within the whole."""
    return 10 + F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)) * 0.74


def page_progress(index: Column, pages: Column, ratio: Column) -> Column:
    n = F.greatest(pages, F.lit(1))
    return 10 + (index + F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))) / n * 78
