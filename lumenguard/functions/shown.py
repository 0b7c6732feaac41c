"""How values and lists of names are shown in messages."""

from __future__ import annotations

import json
import re

MOST_SHOWN, MOST_COLUMNS = 64, 80
NOT_EVALUATED_LABEL = "  not evaluated: "
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f  ]")


def show_string(value: str, quote: str = "") -> str:
    """``value`` on one line: control characters and line separators as JSON writes them, cut at ``MOST_SHOWN`` characters with its length after it."""
    head = value[:MOST_SHOWN]
    if quote:
        head = head.replace("\\", "\\\\").replace(quote, f"\\{quote}")
    shown = _CONTROL.sub(lambda m: json.dumps(m[0])[1:-1] if m[0] < "\x20" else f"\\u{ord(m[0]):04x}", head)
    return f"{quote}{shown}{quote}" if len(value) <= MOST_SHOWN else f"{quote}{shown}...{quote} (length {len(value)})"


def files_glob(folder: str) -> str:
    """The text files of ``folder`` as one word of a shell."""
    name = folder.rstrip("/")
    if not name:
        return "/*.txt"
    if name.startswith("-"):
        name = f"./{name}"
    if not re.fullmatch(r"[A-Za-z0-9_@%+=:,./-]+", name):
        name = "'" + name.replace("'", "'\"'\"'") + "'"
    return f"{name}/*.txt"


def not_evaluated_lines(ids: list[str]) -> list[str]:
    """All ``ids`` after a label, broken between ids before column ``MOST_COLUMNS``."""
    lines: list[str] = []
    for i, name in enumerate(ids):
        word = name + ("," if i < len(ids) - 1 else "")
        if lines and len(lines[-1]) + 1 + len(word) <= MOST_COLUMNS:
            lines[-1] += f" {word}"
        else:
            lines.append((" " * len(NOT_EVALUATED_LABEL) if lines else NOT_EVALUATED_LABEL) + word)
    return lines
