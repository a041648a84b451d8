"""Text, Markdown, JSON and CSV."""

from __future__ import annotations

import csv
import io
import json

from .model import Parsed, ParseError, Recognizer

#: Tried in order; the last takes any bytes.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16", "latin-1")


def decode(data: bytes, bom_first: bool = False) -> tuple[str, str]:
    """Text with line ends as LF, and the encoding that could read it. ``bom_first`` lets a byte order mark decide."""
    order = ENCODINGS
    if bom_first and data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ("utf-16", *ENCODINGS)
    for name in order:
        try:
            return data.decode(name).replace("\r\n", "\n").replace("\r", "\n"), name
        except UnicodeError:
            continue
    raise ParseError("无法识别文件编码")


def parse(data: bytes, suffix: str, ocr: Recognizer | None = None) -> Parsed:
    content, encoding = decode(data)
    out = Parsed(content, method="text")
    if suffix == "json":
        value = json.loads(content)
        out.text = json.dumps(value, ensure_ascii=False, indent=2)
        out.metadata = {"keys": ",".join(value) if isinstance(value, dict) else "", "type": type(value).__name__}
    elif suffix == "csv":
        rows = list(csv.reader(io.StringIO(content)))
        out.tables = [rows]
        out.metadata = {"rows": str(len(rows)), "cols": str(len(rows[0]) if rows else 0)}
    out.metadata |= {"encoding": encoding, "file_size_bytes": str(len(data)), "line_count": str(len(content.splitlines()))}
    return out
