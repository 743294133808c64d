"""Text of conditions, durations and recipes; source-text parameters."""

from __future__ import annotations

import re

_WORDS = {"=": "is", "<>": "is not", ">": "is above", ">=": "is at least", "<": "is below", "<=": "is at most", "between": "is between"}


def phrase(name: str, op: str, value) -> str:
    shown = " and ".join(f"{v:g}" for v in value) if op == "between" else value if isinstance(value, str) else f"{value:g}"
    return f"{name.replace('_', ' ')} {_WORDS[op]} {shown}"


def sentence(conditions: list[tuple]) -> str:
    parts = [phrase(*c) for c in conditions]
    return parts[0] if len(parts) == 1 else ", ".join(parts[:-1]) + " and " + parts[-1]


def duration(bars: int, interval_ms: int) -> str:
    minutes = bars * interval_ms / 60_000
    for size, unit in ((10_080, "week"), (1440, "day"), (60, "hour"), (1, "minute")):
        if minutes >= size:
            n = round(minutes / size, 1)
            return f"{n:g} {unit}{'' if n == 1 else 's'}"
    return "under a minute"


def fnv1a(text: str) -> str:
    """32-bit FNV-1a of UTF-16 code units, eight hex digits."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = ((h ^ (raw[k] | raw[k + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def _arguments(text: str, at: int) -> str:
    """The text between the parenthesis at ``at`` and its partner; quotes are skipped."""
    depth, quote = 0, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote and text[k - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : k]
    return text[at + 1 :]


def source_parameters(text: str) -> dict:
    """Version, title, input defaults and called functions of an indicator script."""
    inputs = []
    for m in re.finditer(r"(\w+)\s*=\s*input\.(\w+)\s*\(", text):
        args = _arguments(text, m.end() - 1)
        first = re.match(r"\s*(?:defval\s*=\s*)?([^,]+)", args)
        title = re.search(r"""(?:title\s*=\s*)?["']([^"']+)["']""", args)
        inputs.append({"name": m[1], "type": m[2], "default": first[1].strip() if first else None, "title": title[1] if title else None})
    version, title = re.search(r"@version=(\d+)", text), re.search(r"""(?:indicator|strategy|study)\s*\(\s*(?:title\s*=\s*)?["']([^"']+)""", text)
    return {"version": int(version[1]) if version else None, "title": title[1] if title else None, "inputs": inputs, "functions": sorted(set(re.findall(r"\bta\.(\w+)", text))), "hash": fnv1a(text)}
