"""Files built here, read back."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from doclake.functions import planning
from doclake.sources import image, ole, ooxml, pdf, plain, read_documents
from doclake.sources.model import Options, ParseError

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def relations(items: dict[str, tuple[str, str]]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="http://x/{kind}" Target="{target}"/>' for k, (kind, target) in items.items()) + "</Relationships>"


def docx() -> bytes:
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in ("a", "b")) + "</w:tr>"
    body = p("Top", "H2") + p("text") + p(" ") + f"<w:tbl>{row}{row}</w:tbl>"
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'})


def xlsx() -> bytes:
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3.14159</v></c></row><row r="3"><c r="A3"><v>-1</v></c><c r="C3" t="b"><v>1</v></c></row>'
    return package({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations({"rId1": ("worksheet", "worksheets/s1.xml")}),
        "xl/worksheets/s1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>", "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    })


def pptx() -> bytes:
    slide = "<p:sld xmlns:p='p' xmlns:a='a'><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    note = "<p:notes xmlns:p='p' xmlns:a='a'><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type='body'/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>remember</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>"
    return package({
        "ppt/presentation.xml": f"<p:presentation xmlns:p='p' {R}><p:sldIdLst><p:sldId r:id='rId1'/></p:sldIdLst><p:sldSz cx='9144000' cy='6858000'/></p:presentation>",
        "ppt/_rels/presentation.xml.rels": relations({"rId1": ("slide", "slides/s1.xml")}), "ppt/slides/s1.xml": slide,
        "ppt/slides/_rels/s1.xml.rels": relations({"rId9": ("notesSlide", "../notesSlides/n1.xml")}), "ppt/notesSlides/n1.xml": note,
    })


def pdf_file(content: bytes, flate: bool = False) -> bytes:
    body = zlib.compress(content) if flate else content
    head = b"/Filter /FlateDecode " if flate else b""
    objects = [
        b"<</Pages 2 0 R/Type/Catalog>>", b"<</Count 1/Kids[3 0 R]/Type/Pages>>",
        b"<</Contents 4 0 R/Resources 6 0 R/Parent 2 0 R/Type/Page>>",
        b"<<" + head + b"/Length %d>>stream\n" % len(body) + body + b"\nendstream", b"<</BaseFont/Helvetica/Subtype/Type1/Type/Font>>", b"<</Font<</F1 5 0 R>>>>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"%%EOF"


def doc(pieces: list[tuple[str, bool]], cut: int = 0) -> bytes:
    """A compound file with one WordDocument and one 1Table stream, both over the small-stream limit."""
    text, places, ends = bytearray(), [], [0]
    for t, wide in pieces:
        at = 1024 + len(text)
        places.append(at if wide else 0x40000000 | at * 2)
        text += t.encode("utf-16-le") if wide else t.encode("cp1252")
        text += b"\0" * (len(text) % 2)
        ends.append(ends[-1] + len(t))
    plc = struct.pack(f"<{len(ends)}I", *ends) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    main = bytearray(4608)
    main[1024 : 1024 + len(text)] = text
    struct.pack_into("<HHHHHH", main, 0, 0xA5EC, 193, 0, 0x409, 0, 0x200)
    struct.pack_into("<II", main, 418, 0, len(clx))
    table = clx[: len(clx) - cut] + b"\0" * (0 if cut else 4608 - len(clx))
    if cut:
        struct.pack_into("<II", main, 418, 0, 999_999)
        table = table + b"\0" * (4608 - len(table))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 0)).ljust(116, b"\0") + struct.pack("<III", start, size, 0)
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, 2, 4608) + entry("1Table", 2, 11, 4608) + b"\0" * 128
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 11), 0xFFFFFFFE, *range(12, 20), 0xFFFFFFFE]
    head = bytearray(512)
    head[:8] = ole.MAGIC
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<5I", head, 56, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    return bytes(head) + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + bytes(main) + table


def test_encodings():
    assert plain.decode("中文".encode()) == ("中文", "utf-8")
    assert plain.decode("中文".encode("gbk")) == ("中文", "gbk")
    assert plain.decode(b"\xef\xbb\xbfa")[0] == "﻿a"
    assert plain.decode("a\r\nb\rc".encode()) == ("a\nb\nc", "utf-8")
    assert plain.decode(b"\xff\xfea\0", bom_first=True) == ("a", "utf-16")
    assert plain.decode(b"\xe9\xff\xe9")[1] == "latin-1"


def test_json_and_csv():
    p = plain.parse(b'{"b": [1], "a": "\xc3\xa9", "b": 2}', "json")
    assert p.text == '{\n  "b": 2,\n  "a": "é"\n}'
    assert (p.metadata["keys"], p.metadata["type"]) == ("b,a", "dict")
    p = plain.parse(b'a,"b\nc"\n\nd\n', "csv")
    assert p.tables == [[["a", "b\nc"], [], ["d"]]]
    assert (p.metadata["rows"], p.metadata["cols"]) == ("3", "2")


def test_word():
    p = ooxml.word(docx(), "docx")
    assert p.text == "\n## Top\ntext"
    assert p.tables == [[["a", "b"]]]
    assert ole.parse(docx(), "doc").text == p.text


def test_excel():
    p = ooxml.excel(xlsx(), "xlsx")
    assert p.tables == [[["name", "3.14159", ""], ["-1", "", "True"]]]
    assert p.numbers == [3.14159, -1.0, 1.0]
    assert p.text == "\n[工作表: One]\nname\t3.14159\t\n-1\t\tTrue"


def test_powerpoint():
    p = ooxml.powerpoint(pptx(), "pptx")
    assert p.text == "[Slide 1]\nHello\n\n  [备注] remember"
    assert (p.slides, p.metadata["slide_width"]) == (1, "25.4")


@pytest.mark.parametrize("flate", [False, True])
def test_pdf_text(flate):
    p = pdf.parse(pdf_file(rb"BT /F1 12 Tf 72 700 Td (First \(line\) of text) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ T* <4869> Tj ET", flate), "pdf")
    assert p.text == "[第 1 页]\nFirst (line) of text\nSecond line\nHi"
    assert p.method == "text layer"


GRID = b"""0.5 w 100 600 300 60 re S 100 620 m 400 620 l S 100 640 m 400 640 l S 200 600 m 200 660 l S 1 0 0 1 200 0 cm 100 620 m 100 660 l S 1 0 0 1 -200 0 cm
BT /F1 10 Tf 105 645 Td (Name) Tj 100 0 Td (Size) Tj 100 0 Td (Note) Tj ET
BT 1 0 0 1 105 625 Tm (first) Tj 1 0 0 1 205 625 Tm [(1) -20 (2)] TJ ET BT 105 605 Td (second) Tj 1 0 0 1 310 605 Tm (wide) Tj ET
BT 1 0 0 1 100 500 Tm (A line of text that stands below the table) Tj ET"""


def test_pdf_tables():
    p = pdf.parse(pdf_file(GRID), "pdf")
    assert p.tables == [[["Name", "Size", "Note"], ["first", "12", ""], ["second", "wide", ""]]]  # the last row's right cells are merged
    assert [x.tables for x in p.pages] == [1]
    assert (p.metadata["table_pages"], p.metadata["pdf_mode"], p.metadata["table_extraction"], p.metadata["file_size_mb"]) == ("1", "balanced", "全页尝试提取表格", "0.0")
    fast = pdf.parse(pdf_file(GRID), "pdf", None, Options(pdf_mode="fast"))
    assert (fast.tables, fast.metadata["table_extraction_enabled"], fast.metadata["pdf_runtime_label"]) == ([], "false", "快速")
    assert pdf.parse(pdf_file(GRID), "pdf", None, Options(no_pdf_tables=True)).tables == []
    assert pdf.parse(pdf_file(b"10 10 100 100 re S BT (A frame is not a table at all) Tj ET"), "pdf").tables == []


def test_pdf_info():
    data = pdf_file(b"BT (A long enough line) Tj ET") + b"\n99 0 obj <</Title (T \\(x\\)) /Author <FEFF6587>>> endobj\ntrailer <</Info 99 0 R>>"
    assert json.loads(pdf.parse(data, "pdf").metadata["info"]) == {"Title": "T (x)", "Author": "文"}


def test_plain_plan_equals_columns(spark):
    cases = [(m, p, float(s), a, b, n) for m in planning.MODES for p in (1, 31, 32, 89, 90) for s in (0, 13.99, 14, 40) for a in (True, False) for b in (True, False) for n in (True, False)]
    d = spark.createDataFrame(cases, "mode string, pages long, mb double, a boolean, b boolean, n boolean")
    got = d.select("*", F.struct(*[c.alias(k) for k, c in planning.pdf_plan(*[F.col(c) for c in ("mode", "pages", "mb", "a", "b", "n")]).items()]).alias("plan")).collect()
    assert len(got) == len(cases)
    for r in got:
        assert r.plan.asDict() == planning.pdf_plan_of(r.mode, r.pages, r.mb, r.a, r.b, r.n)


def test_pdf_without_text():
    with pytest.raises(ParseError):
        pdf.parse(pdf_file(b"BT ET"), "pdf")
    p = pdf.parse(pdf_file(b"BT ET"), "pdf", lambda data, name: ("seen by a machine", "Fake"))
    assert (p.pages[0].source, p.method) == ("ocr", "高分辨率 OCR")
    with pytest.raises(ParseError):
        pdf.parse(b"not one", "pdf")


def test_unicode_map():
    m = pdf.unicode_map(b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange")
    assert m == {b"\0\1": "A", b"\0\2": "a", b"\0\3": "b", b"\0\4": "c"}


def test_old_word():
    text = ole.parse(doc([("Plain words in the first piece.\r", False), ("第二段文字，足够长的一行。\r", True)]), "doc").text
    assert text == "Plain words in the first piece.\n第二段文字，足够长的一行。"
    with pytest.raises(ParseError):
        ole.parse(doc([("Plain words in the first piece.\r", False)], cut=5), "doc")
    with pytest.raises(ParseError):
        ole.parse(b"fake", "doc")


def test_recognizers():
    def broken(data, suffix):
        raise RuntimeError("no model")

    chain = image.Chain([("a", broken, False), ("b", lambda d, s: (" ", ""), False), ("c", lambda d, s: ("text", ""), True)])
    assert chain(b"", "png") == ("text", "c")
    assert image.Chain([("a", broken, False)])(b"", "png")[1] == ""
    assert image.flatten([[["x", 0.9]], {"text": "y"}, {"rec_texts": ["z", ""]}]) == ["x", "y", "z"]
    assert image.collapse(["a", "a", "b", "a"]) == "a\nb\na"


def test_folder(spark, tmp_path):
    files = {"a.txt": b"hello world\n", "b.json": b"{", "c.docx": docx(), "d.xlsx": xlsx(), "e.bin": b"x", "f.png": b"x", "g.docx": b"fake", "empty.txt": b"", "README.md": b"no", "h.pdf": pdf_file(b"BT (A long enough line) Tj ET")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file_name: r for r in read_documents(spark, {"s": str(tmp_path)}).collect()}
    assert sorted(got) == sorted(set(files) - {"README.md"})
    assert {n for n, r in got.items() if not r.success} == {"b.json", "e.bin", "g.docx"}
    assert got["e.bin"].error_info.code == "unsupported_format"
    assert got["g.docx"].error_info.code == "corrupt_file"
    assert got["d.xlsx"].stats.numeric_count == 3
    assert abs(got["d.xlsx"].stats.sum - 3.14159) < 1e-9
    assert (got["a.txt"].stats.word_count, got["empty.txt"].stats.char_count) == (2, 0)
    assert got["c.docx"].tables == [[["a", "b"]]]
