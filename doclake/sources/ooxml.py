"""Word, Excel and PowerPoint packages, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from .model import Parsed, ParseError, Recognizer

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _find(e: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if _local(c) == name), None)
        if e is None:
            return None
    return e


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if _local(c) == name]


def _attribute(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise ParseError("File is not a zip file") from None
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def need(self, name: str) -> ET.Element:
        e = self.xml(name)
        if e is None:
            raise ParseError(f"corrupt package: no {name}")
        return e

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, part)."""
        folder, name = posixpath.split(part)
        e = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in e if e is not None else []:
            target = r.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], path)
        return out

    def core(self) -> dict[str, str]:
        e = self.xml("docProps/core.xml")
        text = {_local(c): c.text or "" for c in e} if e is not None else {}
        return {"title": text.get("title", ""), "author": text.get("creator", ""), "created": text.get("created", ""), "modified": text.get("modified", ""), "revision": text.get("revision", "")}


def _run_text(p: ET.Element) -> str:
    parts = []
    for e in p.iter():
        kind = _local(e)
        if kind == "t":
            parts.append(e.text or "")
        elif kind == "tab" and e is not p:
            parts.append("\t")
        elif kind in ("br", "cr"):
            parts.append("\n")
    return "".join(parts)


def word(data: bytes, suffix: str, ocr: Recognizer | None = None) -> Parsed:
    pack = Package(data)
    body = _find(pack.need("word/document.xml"), "body")
    if body is None:
        raise ParseError("corrupt document: no body")
    styles = pack.xml("word/styles.xml")
    names = {_attribute(s, "styleId"): _attribute(n, "val") for s in (_all(styles, "style") if styles is not None else []) if (n := _find(s, "name")) is not None}
    out = Parsed(metadata=pack.core() | {"original_format": suffix.upper()}, method="docx")
    parts = []
    for p in [c for c in body if _local(c) == "p"]:
        t = _run_text(p)
        if not t.strip():
            continue
        mark = _find(p, "pPr", "pStyle")
        style = _attribute(mark, "val") if mark is not None else ""
        style = names.get(style, style)
        if "heading" in style.lower():
            last = style.split()[-1] if " " in style else (re.search(r"\d+$", style) or [""])[0]
            parts.append(f"\n{'#' * int(last if last.isdigit() else 1)} {t}")
        else:
            parts.append(t)
    for t in [c for c in body if _local(c) == "tbl"]:
        rows: list[list[str]] = []
        for r in [c for c in t if _local(c) == "tr"]:
            cells: list[str] = []
            for c in [c for c in r if _local(c) == "tc"]:
                cell = "\n".join(_run_text(p) for p in c if _local(p) == "p").strip()
                span = _find(c, "tcPr", "gridSpan")
                cells += [cell] * (int(_attribute(span, "val") or 1) if span is not None else 1)
            if cells not in rows:
                rows.append(cells)
        if rows:
            out.tables.append(rows)
    out.text = "\n".join(parts)
    return out


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def excel(data: bytes, suffix: str, ocr: Recognizer | None = None) -> Parsed:
    pack = Package(data)
    book = pack.need("xl/workbook.xml")
    shared = pack.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in _all(s, "t")) for s in (shared if shared is not None else []) if _local(s) == "si"]
    links = pack.relations("xl/workbook.xml")
    out = Parsed(method="xlsx")
    parts, names = [], []
    for sheet in _all(book, "sheet"):
        name = sheet.get("name", "")
        names.append(name)
        parts.append(f"\n[工作表: {name}]")
        e = pack.xml(links.get(sheet.get(f"{_REL}id", ""), ("", ""))[1])
        rows: dict[int, dict[int, str]] = {}
        for k, r in enumerate(_all(e, "row") if e is not None else []):
            cells = rows.setdefault(int(r.get("r", k + 1)) - 1, {})
            for j, c in enumerate(x for x in r if _local(x) == "c"):
                kind, v = c.get("t", "n"), _find(c, "v")
                raw = v.text or "" if v is not None else ""
                value = raw
                if kind == "s" and raw:
                    value = strings[int(raw)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b" and raw:
                    value = "True" if raw == "1" else "False"
                    out.numbers.append(float(raw))
                elif kind == "n" and raw:
                    number = float(raw)
                    out.numbers.append(number)
                    value = str(int(number)) if number.is_integer() and "." not in raw and "E" not in raw.upper() else str(number)
                cells[_column(c.get("r", "")) if c.get("r") else j] = value
        width = max((max(c) for c in rows.values() if c), default=-1) + 1
        table = [[cells.get(j, "") for j in range(width)] for _, cells in sorted(rows.items())]
        table = [r for r in table if any(r)]
        parts += ["\t".join(r) for r in table]
        if table:
            out.tables.append(table)
    out.text = "\n".join(parts)
    out.metadata = {"sheet_names": ",".join(names), "sheet_count": str(len(names))}
    return out


def _shape_texts(e: ET.Element) -> list[str]:
    tree = _find(e, "cSld", "spTree")
    shapes = [s for s in (tree if tree is not None else []) if _local(s) == "sp"]  # tables and groups have no text of their own
    texts = []
    for s in shapes:
        body = _find(s, "txBody")
        texts.append("\n".join(_run_text(p) for p in (body if body is not None else []) if _local(p) == "p").strip())
    return [t for t in texts if t]


def powerpoint(data: bytes, suffix: str, ocr: Recognizer | None = None) -> Parsed:
    pack = Package(data)
    deck = pack.need("ppt/presentation.xml")
    links = pack.relations("ppt/presentation.xml")
    parts, n = [], 0
    for s in _all(deck, "sldId"):
        part = links.get(s.get(f"{_REL}id", ""), ("", ""))[1]
        e = pack.need(part)
        n += 1
        if texts := _shape_texts(e):
            parts.append(f"[Slide {n}]\n" + "\n".join(texts))
        for kind, note in pack.relations(part).values():
            if kind == "notesSlide" and (ns := pack.xml(note)) is not None:
                body = [s for s in _all(ns, "sp") if any(_attribute(p, "type") == "body" for p in _all(s, "ph"))]
                text = "\n".join("\n".join(_run_text(p) for p in _all(s, "p")) for s in body).strip()
                if text:
                    parts.append(f"  [备注] {text}")
    size = _find(deck, "sldSz")
    cm = lambda k: f"{int(size.get(k, 0)) / 360000:g}" if size is not None else ""
    return Parsed("\n\n".join(parts), metadata={"slide_count": str(n), "slide_width": cm("cx"), "slide_height": cm("cy")}, method="pptx", slides=n)
