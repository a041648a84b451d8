"""Failure messages sorted into classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

FORMATS = ("PDF", "DOCX", "XLSX", "PPTX", "TXT", "CSV", "图片", "JSON")
PACKAGES = dict(zip("docx pptx PIL fitz".split(), "python-docx python-pptx Pillow PyMuPDF".split(), strict=True))
DEFAULT = ("parse_failure", "解析失败", "文档解析失败", "请检查文件内容、格式和依赖环境后重试。")
#: Class: (category, title, hint); the first whose test holds is taken.
CLASSES = {
    "missing_dependency": ("依赖缺失", "运行依赖未安装", "请安装对应 Python 依赖后再重试。"),
    "unsupported_format": ("格式不支持", "文件格式暂不支持", f"请改用系统支持的格式，或先转换为 {'/'.join(FORMATS)}。"),
    "encoding_error": ("编码异常", "文件编码无法识别", "建议将文本文件另存为 UTF-8 编码后重试。"),
    "corrupt_file": ("文件损坏", "文件可能损坏或伪装格式", "请确认文件能被原始办公软件正常打开，必要时重新导出。"),
    "ocr_unavailable": ("OCR 不可用", "OCR 依赖或识别链路不可用", "建议安装 EasyOCR，或补齐 Tesseract 运行环境。"),
    "file_not_found": ("文件缺失", "待处理文件不存在", "请确认上传成功或文件路径有效。"),
    "permission_error": ("权限不足", "文件访问权限不足", "请关闭占用文件的程序，或检查读写权限。"),
}
CORRUPT = "clx|fib|piece table|ole2|not a zip file|badzipfile|corrupt".split("|")
_MODULE = r"""(?i)no module named ["']?([\w.-]+)"""


def _has(t: Column, *tokens: str) -> Column:
    out = F.lit(False)
    for x in tokens:
        out = out | F.contains(t, F.lit(x))
    return out


def install_hint(message: Column) -> Column:
    pip = F.regexp_extract(message, r"(?i)(pip install [\w.-]+)", 1)
    module = F.regexp_extract(message, _MODULE, 1)
    package = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PACKAGES.items() for x in kv]), module), module)
    return F.when(pip != "", pip).when(module != "", F.concat(F.lit("pip install "), package)).otherwise("")


def dependency(message: Column) -> Column:
    """Of the module or package named first."""
    found = F.regexp_extract(message, r"""(?i)no module named ["']?[\w.-]+|pip install [\w.-]+""", 0)
    return F.coalesce(F.nullif(F.regexp_extract(found, _MODULE, 1), F.lit("")), F.regexp_extract(found, r"(?i)pip install ([\w.-]+)", 1))


def classify(error: Column) -> Column:
    """A struct (code, category, title, message, hint, severity, dependency, install_command); null for an empty message."""
    m = strip(F.coalesce(error, F.lit("")))
    low = F.lower(m)
    install = install_hint(m)
    tests = {
        "missing_dependency": _has(m, "缺少依赖") | _has(low, "no module named") | (install != ""),
        "unsupported_format": _has(m, "不支持的文件格式") | _has(low, "unsupported"),
        "encoding_error": _has(m, "编码") | _has(low, "unicode", "decode"),
        "corrupt_file": _has(low, *CORRUPT) | _has(m, "损坏"),
        "ocr_unavailable": _has(low, "ocr") & _has(m, "未安装", "不可用", "未识别到内容"),
        "file_not_found": _has(m, "文件不存在") | _has(low, "no such file"),
        "permission_error": _has(m, "权限") | _has(low, "permission"),
    }
    code = F.lit(DEFAULT[0])
    for name in reversed(CLASSES):
        code = F.when(tests[name], name).otherwise(code)

    def text(k: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for n, v in CLASSES.items() for x in (n, v[k])], F.lit(DEFAULT[0]), F.lit(DEFAULT[k + 1])), code)

    hint = F.when(code.isin("missing_dependency", "ocr_unavailable") & (install != ""), install).otherwise(text(2))
    info = F.struct(
        code.alias("code"), text(0).alias("category"), text(1).alias("title"), m.alias("message"), hint.alias("hint"),
        F.when(code == "missing_dependency", "warning").otherwise("error").alias("severity"), dependency(m).alias("dependency"), install.alias("install_command"),
    )
    return F.when(m != "", info)
