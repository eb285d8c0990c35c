"""Arguments of calls as they stand in source text, by a scan that keeps track of brackets and quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

_PART = re.compile(r"'(?:[^'\\]|\\.)*(?:'|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|[(\[{]|[)\]}]|,", re.S)
_LITERAL = re.compile(r"(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\")", re.S)
_KEYWORD = re.compile(r"([A-Za-z_]\w*)\s*=(?!=)\s*")


def split(text: str) -> list[str]:
    """The arguments between commas that stand in no bracket and no string."""
    out, depth, start = [], 0, 0
    for m in _PART.finditer(text):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif m[0] == "," and depth == 0:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [x for x in [*out, text[start:].strip()] if x]


def call(text: str) -> tuple[str, str] | None:
    """(name, arguments) of a decorator that is a call."""
    a, b = text.find("("), text.rfind(")")
    return (text[:a].strip(), text[a + 1 : b]) if 0 <= a < b else None


def first_string(arguments: str) -> str | None:
    """The first argument, if it begins with a plain string."""
    m = _LITERAL.match(arguments.lstrip())
    return (m[1] if m[1] is not None else m[2]) if m else None


def keyword(arguments: str, name: str) -> str | None:
    for x in split(arguments):
        m = _KEYWORD.match(x)
        if m and m[1] == name:
            return x[m.end() :]
    return None


def names(value: str) -> list[str]:
    """The strings of a list, a tuple or a single string, in capitals."""
    inner = value.strip()
    if inner[:1] + inner[-1:] in ("[]", "()", "{}"):
        inner = inner[1:-1]
    return [x.strip("'\"").upper() for x in split(inner) if x.strip("'\"")]


def calls_of(text: str, wanted: tuple[str, ...]) -> Iterator[str]:
    """The arguments of each call of the wanted names, from left to right; those within another's arguments are not looked for."""
    at = 0
    begin = re.compile(rf"(?:{'|'.join(map(re.escape, sorted(wanted, key=len, reverse=True)))})\(")
    while m := begin.search(text, at):
        depth = 1
        for p in _PART.finditer(text, m.end()):
            depth += (p[0] in "([{") - (p[0] in ")]}")
            if not depth:
                yield text[m.end() : p.start()]
                at = p.end()
                break
        else:
            return
