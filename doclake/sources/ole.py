"""Word 97 binary documents: the compound file's streams and the piece table's text."""

from __future__ import annotations

import re
import struct

from ..functions.text import FIELD_WORDS
from .model import Parsed, ParseError, Recognizer
from .ooxml import word

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_FREE = 0xFFFFFFFA  # and above: no sector
CODEPAGES = {0x04: "gbk", 0x804: "gbk", 0x404: "big5", 0xC04: "big5", 0x411: "shift_jis", 0x412: "cp949"}


class Compound:
    """Streams of an OLE2 file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ParseError("not an OLE2 file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        (first_dir,) = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<5I", data, 56)
        sectors = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        per = self.size // 4
        while first_difat < _FREE and first_difat not in seen:
            seen.add(first_difat)
            more = self._numbers(first_difat)
            sectors += more[: per - 1]
            first_difat = more[per - 1] if len(more) >= per else _FREE
        self.fat = [n for s in sectors if s < _FREE for n in self._numbers(s)]
        self.entries: dict[str, tuple[int, int]] = {}
        root = (0, 0)
        table = self._chain(first_dir)
        for at in range(0, len(table) - 127, 128):
            length = struct.unpack_from("<H", table, at + 64)[0]
            name = table[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "ignore")
            start, size = struct.unpack_from("<II", table, at + 116)
            if table[at + 66] == 5:
                root = (start, size)
            elif table[at + 66] == 2:
                self.entries.setdefault(name, (start, size))
        self.mini = self._chain(root[0])[: root[1]] if root[1] else b""
        raw = self._chain(first_mini) if first_mini < _FREE else b""
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _numbers(self, n: int) -> list[int]:
        raw = self._sector(n)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, n: int) -> bytes:
        parts, seen = [], set()
        while n < _FREE and n not in seen:
            seen.add(n)
            parts.append(self._sector(n))
            n = self.fat[n] if n < len(self.fat) else _FREE
        return b"".join(parts)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ParseError(f"OLE2 file has no {name}")
        n, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(n)[:size]
        parts, seen = [], set()
        while n < _FREE and n not in seen:
            seen.add(n)
            parts.append(self.mini[n * self.mini_size : (n + 1) * self.mini_size])
            n = self.mini_fat[n] if n < len(self.mini_fat) else _FREE
        return b"".join(parts)[:size]


def raw_text(data: bytes) -> str:
    """The text of all pieces, in order, as stored."""
    file = Compound(data)
    main = file.stream("WordDocument")
    if len(main) < 426:
        raise ParseError("FIB is too short")
    (flags,) = struct.unpack_from("<H", main, 10)
    (language,) = struct.unpack_from("<H", main, 6)
    table = file.stream("1Table" if flags & 0x200 else "0Table")
    at, size = struct.unpack_from("<II", main, 418)
    clx = table[at : at + size]
    if not size or len(clx) < size:
        raise ParseError("CLX is missing or cut off")
    k = 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k + 5 > len(clx) or clx[k] != 2:
        raise ParseError("no piece table in CLX")
    (length,) = struct.unpack_from("<I", clx, k + 1)
    plc = clx[k + 5 : k + 5 + length]
    n = (len(plc) - 4) // 12
    if n < 1 or len(plc) < length:
        raise ParseError("piece table is cut off")
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    parts = []
    for i in range(n):
        (fc,) = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)
        count = ends[i + 1] - ends[i]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            parts.append(main[start : start + count].decode(CODEPAGES.get(language, "cp1252"), "ignore"))
        else:
            parts.append(main[fc : fc + 2 * count].decode("utf-16-le", "ignore"))
    return "".join(parts)


_TO = str.maketrans({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\xa0": " ", "\x13": None, "\x14": None, "\x15": None})


def readable(raw: str) -> str:
    """What ``functions.text`` does to legacy text, for one string."""
    t = re.sub(r"[\x7f-\x9f\x00-\x08\x0e-\x1f]+", "", raw.translate(_TO))
    t = re.sub("|".join(FIELD_WORDS), " ", t)
    t = re.sub(r"\n\n\n+", "\n\n", re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]{3,}", "  ", t)))
    kept = []
    for line in map(str.strip, t.split("\n")):
        n = len(line)
        share = sum(c.isascii() and c.isalpha() or "\u4e00" <= c <= "\u9fff" or c.isdecimal() for c in line) / max(n, 1)
        dull = n > 10 and len(set(line)) < n * 0.25
        if n and not dull and share > (0.35 if n > 10 else 0.5):
            kept.append(line)
    return "\n".join(kept).strip()


def parse(data: bytes, suffix: str, ocr: Recognizer | None = None) -> Parsed:
    """As a package if it is a renamed one, else by its pieces."""
    try:
        return word(data, suffix)
    except (ParseError, KeyError, ValueError, SyntaxError) as first:
        try:
            text = readable(raw_text(data))
        except (ParseError, struct.error) as second:
            raise ParseError(f"{first}; {second}") from None
    if not text:
        raise ParseError("DOC 文本为空或无法识别")
    return Parsed(text, metadata={"original_format": suffix.upper()}, method="ole2")
