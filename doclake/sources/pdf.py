"""The text layer and ruled tables of PDF files: objects, Flate streams, simple fonts and ToUnicode maps, with the standard library only.

Encrypted files, other filters and fonts without a usable map give no text; such pages go to a recognizer if there is one.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right

from ..functions.planning import DEFAULT_MODE, LABELS, pdf_plan_of
from .model import Options, Page, Parsed, ParseError, Recognizer

_WS = b" \t\r\n\x0c\x00"
_END = _WS + b"()<>[]{}/%"


class Name(str):
    pass


class Ref(int):
    pass


class Keyword(bytes):
    pass


class Reader:
    """Tokens and values from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _WS:
                self.at += 1
            elif d[self.at] == 0x25:
                ends = [e for e in (d.find(b"\n", self.at), d.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(d))
            else:
                return

    def value(self) -> object:
        """The next value; None at the end. Closing brackets come as keywords."""
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if d[at : at + 2] == b"<<":
            self.at += 2
            items = self._until(b">>")
            return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        if c == b"<":
            end = d.find(b">", at)
            self.at = end + 1 if end >= 0 else len(d)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at : self.at])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._literal()
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c == b"/":
            m = re.compile(rb"/([^\s()<>\[\]{}/%\x00]*)").match(d, at)
            self.at = m.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1]).decode("latin-1"))
        if d[at : at + 2] == b">>" or c in b"]{})>":
            self.at += 2 if d[at : at + 2] == b">>" else 1
            return Keyword(d[at : self.at])
        end = at
        while end < len(d) and d[end] not in _END:
            end += 1
        word, self.at = d[at:end], end
        if re.fullmatch(rb"[+-]?\d+", word):
            m = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(d, end)
            if m:
                self.at = m.end()
                return Ref(int(word))
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False}.get(word, Keyword(word))

    def _until(self, close: bytes) -> list[object]:
        out: list[object] = []
        while True:
            v = self.value()
            if v is None or (isinstance(v, Keyword) and v in (close, b"endobj", b"stream")):
                return out
            out.append(None if isinstance(v, Keyword) and v == b"null" else v)

    def _literal(self) -> bytes:
        d, depth, out = self.data, 1, bytearray()
        self.at += 1
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(d):
                e = d[self.at]
                self.at += 1
                if 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(d, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e in (10, 13):
                    self.at += d[self.at - 1 : self.at + 1] == b"\r\n"
                else:
                    out.append(plain.get(e, e))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return bytes(out)


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ParseError("corrupt file: no PDF header")
        self.data = data
        self.at: dict[int, int] = {int(m[1]): m.end() for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b", data)}
        self.made: dict[int, object] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ParseError("encrypted PDF")
        for n in list(self.at):
            o = self.get(Ref(n))
            if isinstance(o, tuple) and o[0].get("Type") == "ObjStm":
                body = self.stream(o)
                head = Reader(body)
                numbers = [head.value() for _ in range(2 * int(self.get(o[0].get("N", 0)) or 0))]
                first = int(self.get(o[0].get("First", 0)) or 0)
                for k, off in zip(numbers[::2], numbers[1::2], strict=False):
                    if isinstance(k, int) and isinstance(off, int) and k not in self.at:
                        self.made[k] = Reader(body, first + off).value()

    def get(self, v: object) -> object:
        seen = 0
        while isinstance(v, Ref) and seen < 50:
            seen += 1
            n = int(v)
            if n not in self.made:
                self.made[n] = None
                self.made[n] = self._object(n) if n in self.at else None
            v = self.made[n]
        return v

    def _object(self, n: int) -> object:
        r = Reader(self.data, self.at[n])
        v = r.value()
        m = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, r.at)
        if isinstance(v, dict) and m:
            size = self.get(v.get("Length"))
            end = m.end() + size if isinstance(size, int) and size >= 0 else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                end = self.data.find(b"endstream", m.end())
            return v, self.data[m.end() : end if end >= 0 else len(self.data)]
        return v

    def stream(self, v: object) -> bytes:
        v = self.get(v)
        if isinstance(v, list):
            return b"\n".join(self.stream(x) for x in v)
        if not isinstance(v, tuple):
            return b""
        head, body = v
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f in ("FlateDecode", "Fl"):
                z = zlib.decompressobj()
                try:
                    body = z.decompress(body) + z.flush()
                except zlib.error:
                    return b""
            elif f in ("ASCIIHexDecode", "AHx"):
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body.split(b">")[0]).decode() or "")
            else:
                return b""
        return body

    def pages(self) -> list[dict]:
        roots = [o for n in sorted(self.at.keys() | self.made.keys()) if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Catalog"]
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: object, inherited: dict) -> None:
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    return
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            here = inherited | {k: node[k] for k in ("Resources",) if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, here)
            elif node.get("Type", "Page") == "Page":
                out.append(here | node)

        for r in roots[-1:]:
            walk(r.get("Pages"), {})
        return out or [o for n in sorted(self.at) if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Page"]

    def fonts(self, page: dict) -> dict[str, dict[bytes, str] | None]:
        """Code to text by font; None for one-byte codes in the common Latin encoding."""
        res = self.get(page.get("Resources"))
        fonts = self.get(res.get("Font")) if isinstance(res, dict) else None
        out: dict[str, dict[bytes, str] | None] = {}
        for name, ref in (fonts or {}).items():
            f = self.get(ref)
            if isinstance(f, dict) and f.get("ToUnicode") is not None:
                out[name] = unicode_map(self.stream(f["ToUnicode"]))
            else:
                out[name] = {} if isinstance(f, dict) and f.get("Subtype") == "Type0" else None
        return out


def unicode_map(body: bytes) -> dict[bytes, str]:
    r, stack, out = Reader(body), [], {}
    text = lambda b: b.decode("utf-16-be", "ignore")
    while (v := r.value()) is not None:
        if not isinstance(v, Keyword):
            stack.append(v)
            continue
        if v == b"endbfchar":
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[a] = text(b)
        elif v == b"endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                lo, hi = int.from_bytes(a), int.from_bytes(b)
                for k in range(lo, min(hi, lo + 65535) + 1):
                    code = k.to_bytes(len(a))
                    if isinstance(c, list):
                        if k - lo < len(c) and isinstance(c[k - lo], bytes):
                            out[code] = text(c[k - lo])
                    elif isinstance(c, bytes) and c:
                        out[code] = text((int.from_bytes(c) + k - lo).to_bytes(len(c)))
        stack = []
    return out


def _decode(b: bytes, font: dict[bytes, str] | None) -> str:
    if font is None:
        if b[:2] == b"\xfe\xff":
            return b[2:].decode("utf-16-be", "ignore")
        return b.decode("cp1252", "replace").replace("�", "")
    width = max((len(k) for k in font), default=2)
    return "".join(font.get(b[i : i + width], "") for i in range(0, len(b), width))


def page_text(file: File, page: dict) -> str:
    fonts, font = file.fonts(page), None
    r, args, lines, line = Reader(file.stream(page.get("Contents"))), [], [], []
    y, leading = 0.0, 0.0

    def newline() -> None:
        nonlocal line
        if line:
            lines.append("".join(line))
        line = []

    while (v := r.value()) is not None:
        if not isinstance(v, Keyword):
            args.append(v)
            continue
        numbers = [float(a) for a in args if isinstance(a, (int, float))]
        if v == b"Tf" and args and isinstance(args[0], Name):
            font = fonts.get(str(args[0]))
        elif v in (b"Tj", b"'", b'"'):
            if v != b"Tj":
                newline()
            line += [_decode(a, font) for a in args if isinstance(a, bytes) and not isinstance(a, Keyword)]
        elif v == b"TJ" and args and isinstance(args[-1], list):
            for a in args[-1]:
                if isinstance(a, bytes):
                    line.append(_decode(a, font))
                elif isinstance(a, (int, float)) and a < -200:
                    line.append(" ")
        elif v in (b"Td", b"TD") and len(numbers) >= 2:
            if numbers[1]:
                newline()
            elif line and numbers[0] > 0:
                line.append(" ")
            leading = -numbers[1] if v == b"TD" else leading
        elif v == b"Tm" and len(numbers) >= 6:
            if numbers[5] != y:
                newline()
            y = numbers[5]
        elif v in (b"T*", b"ET"):
            newline()
        elif v == b"BI":  # an inline image is passed over
            end = re.compile(rb"\sEI\b").search(r.data, r.at)
            r.at = end.end() if end else len(r.data)
        args = []
    newline()
    return "\n".join(lines)


Matrix = tuple[float, float, float, float, float, float]
#: Distance up to which two rulings are one, and least length of a ruling.
SNAP = 3.0


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def layout(file: File, page: dict) -> tuple[list[tuple[float, float, str]], list[tuple[float, float, float, float]]]:
    """Text pieces (x, y, text) where they begin, and straight strokes and sides of rectangles (x0, y0, x1, y1) of a page."""
    fonts, font, size, leading = file.fonts(page), None, 1.0, 0.0
    r, args = Reader(file.stream(page.get("Contents"))), []
    ctm: Matrix = (1, 0, 0, 1, 0, 0)
    line_at = at = ctm
    stack: list[Matrix] = []
    texts: list[tuple[float, float, str]] = []
    path: list[tuple[float, float, float, float]] = []
    rules: list[tuple[float, float, float, float]] = []
    begin = here = (0.0, 0.0)

    def point(x: float, y: float) -> tuple[float, float]:
        return ctm[0] * x + ctm[2] * y + ctm[4], ctm[1] * x + ctm[3] * y + ctm[5]

    def say(t: str) -> None:
        nonlocal at
        whole = _times(at, ctm)
        texts.append((whole[4], whole[5], t))
        at = _times((1, 0, 0, 1, len(t) * size * 0.5, 0), at)  # about half its size a character

    def move(x: float, y: float) -> None:
        nonlocal line_at, at
        line_at = at = _times((1, 0, 0, 1, x, y), line_at)

    while (v := r.value()) is not None:
        if not isinstance(v, Keyword):
            args.append(v)
            continue
        n = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        if v == b"q":
            stack.append(ctm)
        elif v == b"Q" and stack:
            ctm = stack.pop()
        elif v == b"cm" and len(n) >= 6:
            ctm = _times(tuple(n[:6]), ctm)
        elif v == b"BT":
            line_at = at = (1, 0, 0, 1, 0, 0)
        elif v == b"Tf" and args and isinstance(args[0], Name):
            font, size = fonts.get(str(args[0])), n[0] if n else size
        elif v == b"TL" and n:
            leading = n[0]
        elif v == b"Tm" and len(n) >= 6:
            line_at = at = tuple(n[:6])
        elif v in (b"Td", b"TD") and len(n) >= 2:
            leading = -n[1] if v == b"TD" else leading
            move(n[0], n[1])
        elif v == b"T*":
            move(0, -leading)
        elif v in (b"Tj", b"'", b'"'):
            if v != b"Tj":
                move(0, -leading)
            for a in args:
                if isinstance(a, bytes) and not isinstance(a, Keyword):
                    say(_decode(a, font))
        elif v == b"TJ" and args and isinstance(args[-1], list):
            for a in args[-1]:
                if isinstance(a, bytes):
                    say(_decode(a, font))
                elif isinstance(a, (int, float)):
                    if a < -200:
                        gap = _times(at, ctm)
                        texts.append((gap[4], gap[5], " "))
                    at = _times((1, 0, 0, 1, -a / 1000 * size, 0), at)
        elif v == b"re" and len(n) >= 4:
            (x0, y0), (x1, y1) = point(n[0], n[1]), point(n[0] + n[2], n[1] + n[3])
            path += [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
        elif v == b"m" and len(n) >= 2:
            begin = here = point(n[0], n[1])
        elif v == b"l" and len(n) >= 2:
            there = point(n[0], n[1])
            path.append((*here, *there))
            here = there
        elif v == b"h":
            path.append((*here, *begin))
            here = begin
        elif v in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            if v in (b"s", b"b", b"b*"):
                path.append((*here, *begin))
            rules += path
            path = []
        elif v == b"n":
            path = []
        elif v == b"BI":
            end = re.compile(rb"\sEI\b").search(r.data, r.at)
            r.at = end.end() if end else len(r.data)
        args = []
    return texts, rules


def _snapped(values: list[float]) -> list[float]:
    """Sorted values, those within SNAP of the one before as one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > SNAP:
            out.append(v)
    return out


def page_tables(file: File, page: dict) -> list[list[list[str]]]:
    """Tables of a page by their rulings: connected horizontal and vertical lines are a grid; what begins in a cell is its text.

    A cell spans to the next ruling that bounds it, so that of merged cells the first has the text and the others are empty.
    """
    texts, rules = layout(file, page)
    flat = [(min(x0, x1), max(x0, x1), (y0 + y1) / 2) for x0, y0, x1, y1 in rules if abs(y0 - y1) <= 1 and abs(x0 - x1) > SNAP]
    tall = [(min(y0, y1), max(y0, y1), (x0 + x1) / 2) for x0, y0, x1, y1 in rules if abs(x0 - x1) <= 1 and abs(y0 - y1) > SNAP]
    parent = list(range(len(flat) + len(tall)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    tall_order = sorted(range(len(tall)), key=lambda k: tall[k][2])
    at_x = [tall[k][2] for k in tall_order]
    for i, (x0, x1, y) in enumerate(flat):
        for k in tall_order[bisect_right(at_x, x0 - SNAP - 1e-9) : bisect_right(at_x, x1 + SNAP)]:
            if tall[k][0] - SNAP <= y <= tall[k][1] + SNAP:
                parent[find(i)] = find(len(flat) + k)
    groups: dict[int, tuple[list, list]] = {}
    for k in range(len(parent)):
        part = groups.setdefault(find(k), ([], []))
        part[k >= len(flat)].append(flat[k] if k < len(flat) else tall[k - len(flat)])
    found = []
    for across, down in groups.values():
        xs, ys = _snapped([x for *_, x in down]), _snapped([y for *_, y in across])
        if len(xs) < 2 or len(ys) < 2 or len(xs) + len(ys) < 5:
            continue  # a frame is no table
        rows: list[list[list[tuple[float, float, str]]]] = [[[] for _ in xs[1:]] for _ in ys[1:]]
        for x, y, t in texts:
            c, r = bisect_right(xs, x + 0.01) - 1, bisect_right(ys, y + 0.01) - 1
            if 0 <= c < len(xs) - 1 and 0 <= r < len(ys) - 1:
                while c and not any(abs(x0 - xs[c]) <= SNAP and lo - SNAP <= y <= hi + SNAP for lo, hi, x0 in down):
                    c -= 1
                rows[len(ys) - 2 - r][c].append((x, y, t))
        table = []
        for row in rows:
            cells = []
            for pieces in row:
                by_line: dict[int, list[tuple[float, str]]] = {}
                for x, y, t in pieces:
                    by_line.setdefault(-round(y), []).append((x, t))
                cells.append("\n".join("".join(t for _, t in by_line[k]).strip() for k in sorted(by_line)).strip())
            table.append(cells)
        if any(c for r in table for c in r):
            found.append((-ys[-1], xs[0], table))
    return [t for *_, t in sorted(found, key=lambda f: f[:2])]


def info(file: File) -> dict[str, str]:
    """The document information dictionary."""
    refs = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", file.data)
    found = file.get(Ref(int(refs[-1]))) if refs else None
    out = {}
    for k, v in (found or {}).items() if isinstance(found, dict) else ():
        v = file.get(v)
        out[str(k)] = (v[2:].decode("utf-16-be", "ignore") if v[:2] == b"\xfe\xff" else v.decode("latin-1")) if isinstance(v, bytes) else str(v)
    return out


def parse(data: bytes, suffix: str, ocr: Recognizer | None = None, options: Options = Options()) -> Parsed:
    """Text of all pages under page marks and tables of those that the plan names; pages without a meaningful text layer go to ``ocr``."""
    file = File(data)
    pages = file.pages()
    if not pages:
        raise ParseError("corrupt file: no pages")
    mode = options.pdf_mode.strip().lower() if options.pdf_mode.strip().lower() in LABELS else DEFAULT_MODE
    size_mb = len(data) / (1024 * 1024)
    no_tables = options.no_pdf_tables or os.environ.get("DOCLAKE_DISABLE_PDF_TABLES", "").strip().lower() in ("1", "true", "yes", "on")
    plan = pdf_plan_of(mode, len(pages), size_mb, True, False, no_tables)
    out, parts, engine = Parsed(method="text layer"), [], ""
    for n, page in enumerate(pages, 1):
        text, source, error, tables = normalize(page_text(file, page)), "text layer", "", []
        if not meaningful(text, plan["min_signal"]):
            source = "ocr"
            if ocr is None:
                error, text = "no text layer" if not text else "", text
            else:
                try:
                    text, engine = ocr(data, f"pdf#{n}")
                    text = normalize(text)
                except Exception as e:  # a recognizer's failure is the page's, not the document's
                    error = str(e)
        if plan["extract_tables"] and (plan["table_page_cap"] is None or n - 1 < plan["table_page_cap"]):
            try:
                tables = page_tables(file, page)
                out.tables += tables
            except Exception as e:  # neither is a table's
                error = error or f"table: {e}"
        out.pages.append(Page(n, source, text, len(tables), error))
        if text:
            parts.append(f"[第 {n} 页]\n{text}")
    out.text = "\n\n".join(parts).strip()
    if not out.text:
        raise ParseError("PDF 解析失败：无法读取文本层，也未识别到内容")
    count = lambda k: sum(bool(p.text) and p.source == k for p in out.pages)
    read, seen = count("text layer"), count("ocr")
    out.method = "逐页混合提取（文本层 + OCR）" if seen and read else "高分辨率 OCR" if seen else "text layer"
    cap = plan["table_page_cap"]
    out.metadata = {
        "pages": str(len(pages)), "info": json.dumps(info(file), ensure_ascii=False, sort_keys=True), "text_pages": str(read), "ocr_pages": str(seen),
        "table_pages": str(sum(p.tables > 0 for p in out.pages)), "primary_engine": "text layer", "ocr_engine": engine, "pdf_mode": mode, "pdf_mode_label": LABELS[mode],
        "pdf_runtime_label": plan["runtime_label"], "file_size_mb": str(round(size_mb, 2)), "large_pdf_optimized": str(plan["is_large"]).lower(),
        "table_extraction_enabled": str(plan["extract_tables"]).lower(), "table_page_cap": "" if cap is None else str(cap), "table_extraction": plan["table_label"],
    }
    return out


def normalize(t: str) -> str:
    return re.sub(r"\n\n\n+", "\n\n", "\n".join(x.rstrip() for x in t.replace("\x00", " ").splitlines())).strip()


def meaningful(t: str, least: int = 8) -> bool:
    return len(t) >= 20 or sum(c.isascii() and c.isalnum() or "一" <= c <= "鿿" for c in t) >= least
