"""Images by way of a recognizer, and the choice among recognizers."""

from __future__ import annotations

from collections.abc import Sequence

from .model import Parsed, Recognizer

NO_ENGINE = "未检测到可用 OCR 引擎"


def parse(data: bytes, suffix: str, ocr: Recognizer | None = None) -> Parsed:
    """An image that nothing can read is no failure: its text says so, and ocr_available tells."""
    if ocr is None:
        return Parsed(NO_ENGINE, metadata={"ocr_available": "false", "ocr_engine": ""}, method="OCR")
    text, engine = ocr(data, suffix)
    return Parsed(text.strip(), metadata={"ocr_available": str(bool(engine)).lower(), "ocr_engine": engine}, method="OCR")


class Chain:
    """Recognizers tried in order. Those that accept a blank text end the search with it; others hand on."""

    def __init__(self, engines: Sequence[tuple[str, Recognizer, bool]]):
        self.engines = engines

    def __call__(self, data: bytes, suffix: str) -> tuple[str, str]:
        notes = []
        for name, engine, accepts_blank in self.engines:
            try:
                text, _ = engine(data, suffix)
            except Exception as e:  # the next engine may do better
                notes.append(f"{name}: {e}")
                continue
            if text.strip() or accepts_blank:
                return text, name
            notes.append(f"{name}: blank")
        return "；".join([NO_ENGINE, *notes]), ""


def collapse(lines: list[str]) -> str:
    """Lines without those equal to the one before."""
    return "\n".join(x for k, x in enumerate(lines) if k == 0 or x != lines[k - 1])


def flatten(payload: object, keys: Sequence[str] = ("text", "rec_texts", "rec_text", "txts", "label", "transcription")) -> list[str]:
    """All texts of a recognizer's answer, however it nests lists, tuples and dictionaries."""
    if isinstance(payload, str):
        return [payload.strip()] if payload.strip() else []
    if isinstance(payload, dict):
        for k in keys:
            if found := flatten(payload.get(k), keys):
                return found
        return [t for v in payload.values() if isinstance(v, (list, tuple, dict)) for t in flatten(v, keys)]
    if isinstance(payload, (list, tuple)):
        return [t for v in payload for t in flatten(v, keys)]
    return []
