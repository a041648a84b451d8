"""What a parser returns, and how parsers are found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Page:
    page: int
    source: str
    text: str
    tables: int = 0
    error: str = ""


@dataclass
class Parsed:
    text: str = ""
    tables: list[list[list[str]]] = field(default_factory=list)
    pages: list[Page] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    numbers: list[float] = field(default_factory=list)
    method: str = ""
    slides: int | None = None


class ParseError(ValueError):
    """A document that can't be read; its message becomes the row's error."""


@dataclass(frozen=True)
class Options:
    """What a caller asks of parsers: the PDF mode, and whether tables of PDF files are switched off."""

    pdf_mode: str = "balanced"
    no_pdf_tables: bool = False


#: Recognises text in an image: (bytes, suffix) -> (text, engine).
Recognizer = Callable[[bytes, str], tuple[str, str]]
Parser = Callable[[bytes, str, Recognizer | None], Parsed]
