"""Tokens of brace languages: strings, comments, raw strings, templates and preprocessor lines are known as such, so that what stands in them is no code."""

from __future__ import annotations

import re
from dataclasses import dataclass

_NESTED_COMMENTS = ("rust", "swift", "dart")
_ENDS_LINES = ("typescript", "javascript", "go", "swift")
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"?'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'?"
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{[^}]*\}|u+[0-9A-Fa-f]{4}|x[0-9A-Fa-f]+|[0-7]{1,3}|.))'"
#: Literals by language, the most special first; one alternative each.
_LITERALS = {
    "rust": [r'b?r(#*)"[\s\S]*?"\1', r'[bc]?"(?:[^"\\]|\\[\s\S])*"?', "b?" + _CHAR],
    "go": [r"`[^`]*`?", _STRING, _CHAR],
    "java": [r'"""[\s\S]*?"""', _STRING, _CHAR],
    "csharp": [r'"""[\s\S]*?"""', r'(?:@\$?|\$@)"(?:[^"]|"")*"?', r"\$?" + _STRING, _CHAR],
    "c": [_STRING, _CHAR],
    "cpp": [r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\([\s\S]*?\)\1"', _STRING, _CHAR],
    "typescript": [_STRING, _SINGLE],
    "swift": [r'(#+)"[\s\S]*?"\1', r'"""[\s\S]*?"""', _STRING],
    "php": [r'"(?:[^"\\]|\\[\s\S])*"?', r"'(?:[^'\\]|\\[\s\S])*'?"],
    "dart": [r"r'''[\s\S]*?'''|r\"\"\"[\s\S]*?\"\"\"|r'[^'\n]*'?|r\"[^\"\n]*\"?", r"'''[\s\S]*?'''", r'"""[\s\S]*?"""', _STRING, _SINGLE],
}
_LITERALS["javascript"] = _LITERALS["typescript"]
#: After one of these a slash of a script begins a pattern.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new))\s*$")
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TOKEN = re.compile(r"[A-Za-z_$\x80-\U0010ffff][\w$]*|\d[\w.]*|\"|::|->|=>|\?\.|\?\?|&&|\|\||\S")


def _master(language: str) -> re.Pattern:
    comment = r"//[^\n]*|/\*|" + (r"\#(?!\[)[^\n]*|" if language == "php" else "")
    template = "`|" if language in ("typescript", "javascript") else ""
    directive = r"^[ \t]*\#(?:[^\n\\]|\\[\s\S])*|" if language in ("c", "cpp", "csharp") else ""
    slash = "/" if language in ("typescript", "javascript") else "(?!)"
    literals = "|".join(re.sub(r"\\1", f"(?P=g{i})", re.sub(r"(?<!\\)\((?!\?)", f"(?P<g{i}>", x, count=1)) if r"\1" in x else x for i, x in enumerate(_LITERALS[language]))
    return re.compile(f"(?P<skip>{directive}{comment.rstrip('|')})|(?P<open>{template.rstrip('|') or '(?!)'})|(?P<text>{literals})|(?P<slash>{slash})", re.M)


_MASTERS = {x: _master(x) for x in _LITERALS}


def blanked(text: str, language: str) -> str:
    """The text at its own places with comments and directives blank, and strings as two quotes around blanks. Code inside of templates stays."""
    out: list[str] = []
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    quoted = lambda s: '"' + blank(s[1:-1]) + '"' if len(s) > 1 else blank(s)
    master, at, depth = _MASTERS[language], 0, []
    stop = re.compile(r"[{}]")
    while True:
        m = master.search(text, at)
        if depth:  # inside of ${ }: its closing brace leads back into the template
            b = stop.search(text, at)
            while b and (not m or b.start() < m.start()):
                depth[-1] += 1 if b[0] == "{" else -1
                out.append(text[at : b.end()] if depth[-1] else text[at : b.start()] + ")")
                at = b.end()
                if not depth[-1]:
                    depth.pop()
                    at = _template(text, at, out, depth, blank)
                    break
                b = stop.search(text, at)
            else:
                b = None
            if b:
                continue
        if not m:
            out.append(text[at:])
            return "".join(out)
        out.append(text[at : m.start()])
        at = m.end()
        if m["open"]:
            out.append(" ")
            at = _template(text, at, out, depth, blank)
        elif m["slash"]:
            p = _PATTERN.match(text, m.start()) if _BEFORE_PATTERN.search("".join(out[-8:])[-40:]) else None
            at = p.end() if p else m.end()
            out.append(quoted(p[0]) if p else "/")
        elif m["text"] is not None:
            out.append(quoted(m["text"]))
        elif m["skip"] != "/*":
            out.append(blank(m["skip"]))
        else:
            level, end = 1, at
            for c in re.compile(r"/\*|\*/").finditer(text, at):
                level += -1 if c[0] == "*/" else 1 if language in _NESTED_COMMENTS else 0
                end = c.end()
                if not level:
                    break
            else:
                end = len(text)
            out.append(blank(text[m.start() : end]))
            at = end


def _template(text: str, at: int, out: list[str], depth: list[int], blank) -> int:
    """Blanks a template up to its end or up to an expression in it, whose `${` becomes a bracket; says where to go on."""
    m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match(text, at)
    out.append(blank(text[at : m.end()]))
    if text.startswith("${", m.end()):
        depth.append(1)
        out.append(" (")
        return m.end() + 2
    out.append(" " if m.end() < len(text) else "")
    return min(len(text), m.end() + 1)


@dataclass
class Tokens:
    """Words and signs with their places; `pair` leads from each bracket to its partner (the end, for one that has none)."""

    text: list[str]
    at: list[int]
    pair: dict[int, int]


_CONTINUES = {"extends", "implements", "instanceof", "in", "of", "as", "is", "from", "else", "catch", "finally", "where", "satisfies", "throws", "async"}


def tokens(code: str, language: str) -> Tokens:
    """The tokens of blanked text. Where a line's end ends a statement, there is a `;`."""
    words, places = [], []
    level: list[str] = []
    for m in _TOKEN.finditer(code):
        t = m[0]
        if language in _ENDS_LINES and words and (not level or level[-1] == "{") and "\n" in code[places[-1] : m.start()]:
            last = words[-1]
            if (re.match(r"[\w$\")\]}]", last[-1]) and last not in _CONTINUES) and (re.match(r"[\w$@#\[\"]", t) and t not in _CONTINUES):
                words.append(";")
                places.append(places[-1] + len(last) - 1)
        if t in "([{":
            level.append(t)
        elif t in ")]}" and level:
            level.pop()
        words.append(t)
        places.append(m.start())
    pair: dict[int, int] = {}
    stack: list[int] = []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(words):
        if t in "([{":
            stack.append(i)
        elif t in closes:
            while stack and words[stack[-1]] != closes[t] and any(words[s] == closes[t] for s in stack):
                pair[stack.pop()] = i
            if stack and words[stack[-1]] == closes[t]:
                o = stack.pop()
                pair[o], pair[i] = i, o
    for o in stack:
        pair[o] = len(words)
    return Tokens(words, places, pair)
