"""Names of suites to folders."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from pathlib import Path


def resolve(names: Iterable[str], aliases: Mapping[str, str] | None = None, root: str = ".") -> dict[str, str]:
    """The first existing folder of each name: its alias, as given, or under ``root``; each folder once."""
    found: dict[str, str] = {}
    for name in (str(n or "").strip() for n in names):
        known = [aliases[name]] if aliases and name in aliases else []
        for place in [*known, name, os.path.join(root, name)] if name else []:
            folder = Path(place).resolve()
            if os.path.normcase(folder) in map(os.path.normcase, found.values()):
                continue
            if folder.is_dir():
                found[name] = str(folder)
                break
    return found
