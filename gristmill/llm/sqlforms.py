"""Problem 10's one form of writing as DuckDB SQL, made by rule from the same tables."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from gristmill.llm.uniform import mappings


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _maps() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that become one other or none, and those that become several; what composition alone brings about is left to it."""
    tables = mappings()
    single, several = {}, {}
    for k, start, n in zip(tables["keys"].tolist(), tables["starts"].tolist(), tables["sizes"].tolist()):
        to = "".join(map(chr, tables["flat"][start : start + n]))
        if k and unicodedata.normalize("NFC", to) != unicodedata.normalize("NFC", chr(k)):
            (single if n < 2 else several)[chr(k)] = to
    return single, several


def one_form(x: str) -> str:
    """SQL for the one form of the text ``x``."""
    single, several = _maps()
    kept = {a: b for a, b in single.items() if b}
    gone = "".join(a for a, b in single.items() if not b)
    out = f"translate({x}, {_quoted(''.join(kept) + gone)}, {_quoted(''.join(kept.values()))})"
    for a, b in several.items():
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"nfc_normalize({out})"
