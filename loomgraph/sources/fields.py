"""Fields of types: what a class or struct declares in its body, and in Python what `__init__` puts on `self`."""

from __future__ import annotations

import ast
import re

_SCRIPTS = ("typescript", "javascript")
_MODIFIERS = frozenset("public private protected internal static final abstract virtual override readonly const declare accessor volatile transient mutable constexpr inline late covariant external required new unsafe extern sealed fileprivate open var".split())
_TYPE_WORDS = frozenset("class struct enum union interface record namespace using typedef friend return operator template static_assert import package factory event delegate".split())
_NAME = re.compile(r"[A-Za-z_$\x80-\U0010ffff][\w$]*$")
_LONGEST = 100


def _row(owner: str, name: str, kind: str | None, visibility: str, default: str | None, line: int, place: int) -> dict:
    return {"owner": owner, "name": name, "type": kind or None, "visibility": visibility, "default": default[:_LONGEST] if default else None, "line": line, "place": place}


def python_fields(n: ast.ClassDef, owner: str, lines: list[bytes]) -> list[dict]:
    """Assignments of a class's body, but for constants; then those to `self` in `__init__`, each name once. Texts as they stand in the source."""

    def text(first: ast.AST, last: ast.AST) -> str:
        rows = lines[first.lineno - 1 : last.end_lineno]
        rows[-1] = rows[-1][: last.end_col_offset]
        rows[0] = rows[0][first.col_offset :]
        return b"".join(rows).decode("utf-8", "replace")

    shown = lambda name: "private" if name.startswith("_") and not (name.startswith("__") and name.endswith("__")) else "public"
    out: list[dict] = []
    for s in n.body:
        if not isinstance(s, ast.Assign | ast.AnnAssign):
            continue
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        if isinstance(targets[0], ast.Name) and not re.match(r"[A-Z][A-Z_0-9]+$", targets[0].id):
            value = text(targets[1] if len(targets) > 1 else s.value, s.value) if s.value else None
            out.append(_row(owner, targets[0].id, text(s.annotation, s.annotation) if isinstance(s, ast.AnnAssign) else None, shown(targets[0].id), value, s.lineno, len(out)))
    seen = {r["name"] for r in out}
    put = [s for f in n.body if isinstance(f, ast.FunctionDef) and f.name == "__init__" for b in f.body for s in ast.walk(b) if isinstance(s, ast.Assign | ast.AnnAssign)]
    for s in sorted(put, key=lambda s: (s.lineno, s.col_offset)):
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        for t, after in zip(targets, [*targets[1:], s.value], strict=True):
            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and t.attr not in seen:
                seen.add(t.attr)
                out.append(_row(owner, t.attr, None, shown(t.attr), text(after, s.value) if after else None, t.lineno, len(out)))
    return out


def _find(f, lo: int, hi: int, sign: str) -> int:
    """Where a sign stands outside of brackets; hi if it doesn't."""
    i = lo
    while i < hi and f.tok.text[i] != sign:
        i = min(hi, f.tok.pair.get(i, hi)) + 1 if f.tok.text[i] in "([{" else i + 1
    return min(i, hi)


def _members(f, lo: int, hi: int) -> list[tuple[int, int, bool]]:
    """(from, to, whether a block follows) of each declaration of a body. In Go a line's end ends one."""
    t, out, start, i = f.tok.text, [], lo, lo
    while i < hi:
        if f.language == "go" and i > start and f.line(i) != f.line(i - 1):
            out.append((start, i, False))
            start = i
        if t[i] == ";":
            out.append((start, i, False))
            start = i + 1
        elif t[i] in "([":
            i = min(hi, f.tok.pair.get(i, hi))
        elif t[i] == "{":
            end = min(hi, f.tok.pair.get(i, hi))
            if f.language != "go" and _find(f, start, i, "=") == i and not (f.language in _SCRIPTS and ":" in t[start:i] and "(" not in t[start:i]):
                out.append((start, i, True))
                start = end + 1
            i = end
        i += 1
    return [m for m in [*out, (start, hi, False)] if m[1] > m[0]]


def _rust(f, owner: str, lo: int, hi: int) -> list[dict]:
    from loomgraph.sources.braced import _first, _split

    t, out = f.tok.text, []
    for a, b in _split(f, lo, hi):
        at = i = _first(f, a, b)
        shown = "private"
        if t[i : i + 1] == ["pub"]:
            inside = t[i + 2 : f.tok.pair.get(i + 1, i + 2)] if t[i + 1 : i + 2] == ["("] else []
            shown, i = ("pub(crate)" if "crate" in inside else "pub"), f.tok.pair.get(i + 1, b) + 1 if t[i + 1 : i + 2] == ["("] else i + 1
        if i + 1 < b and t[i + 1] == ":":
            out.append(_row(owner, t[i], f.source(i + 2, b), shown, None, f.line(at), len(out)))
    return out


def _go(f, owner: str, lo: int, hi: int) -> list[dict]:
    t, out = f.tok.text, []
    for a, b, _ in _members(f, lo, hi):
        while b > a and t[b - 1] == '"':  # the tag
            b -= 1
        if b == a:
            continue
        i, names = a, []
        while i + 1 < b and _NAME.match(t[i]) and t[i + 1] == ",":
            names.append(t[i])
            i += 2
        whole = f.source(a, b)
        if not names and (t[a] == "*" or b - a == 1 or t[a + 1] == "."):  # embedded
            names, kind = [whole.removeprefix("*").replace(" ", "")], whole
        else:
            names, kind = [*names, t[i]], f.source(i + 1, b)
        out += [_row(owner, x, kind, "exported" if x[:1].isupper() and x[:1].isascii() else "unexported", None, f.line(a), len(out) + k) for k, x in enumerate(names)]
    return out


def _script(f, owner: str, lo: int, hi: int) -> list[dict]:
    from loomgraph.sources.braced import _first

    t, out = f.tok.text, []
    for a, b, block in _members(f, lo, hi):
        i = at = _first(f, a, b)
        shown = "private"
        while i + 1 < b and t[i] in _MODIFIERS and _NAME.match(t[i + 1]):
            shown = t[i] if t[i] in ("public", "private", "protected") else shown
            i += 1
        if block or i >= b or not _NAME.match(t[i]):
            continue
        j = i + 2 if i + 1 < b and t[i + 1] in "?!" else i + 1
        equals = _find(f, j, b, "=")
        if j < b and t[j] not in (":", "="):
            continue  # a method without a body
        kind = f.source(j + 1, equals) if j < b and t[j] == ":" else None
        out.append(_row(owner, t[i], kind, shown, f.source(equals + 1, b) or None, f.line(at), len(out)))
    return out


def _typed(f, what: str, owner: str, lo: int, hi: int) -> list[dict]:
    """Type, then name: Java, C#, C, C++ and Dart. Constants of Java and C# are no fields; access in C++ is that of the label above."""
    from loomgraph.sources.braced import _first, _split

    t, out = f.tok.text, []
    access = "private" if what == "class" else "public"
    for a, b, block in _members(f, lo, hi):
        i = _first(f, a, b)
        while f.language == "cpp" and i + 1 < b and t[i] in ("public", "private", "protected") and t[i + 1] == ":":
            access, i = t[i], i + 2
        while i < b and t[i] == "[":
            i = f.tok.pair.get(i, b) + 1
        stop = min(_find(f, i, b, "="), _find(f, i, b, "=>"))
        if block and f.language not in ("csharp", "cpp") or any(x in _TYPE_WORDS for x in t[i:stop]) or _find(f, i, stop, "(") < stop or i >= stop:
            continue
        words = {x for x in t[i:stop] if x in _MODIFIERS}
        if f.language == "java" and {"static", "final"} <= words or f.language == "csharp" and ("const" in words or {"static", "readonly"} <= words):
            continue
        at, kind = f.line(i), None
        for n, (x, y) in enumerate(_split(f, i, b)):
            equals = min(_find(f, x, y, "="), _find(f, x, y, "=>"))
            head = min(equals, _find(f, x, equals, ":"))
            names = [k for k in range(x, head) if _NAME.match(t[k])]
            if not names:
                break
            last = names[-1]
            if not n:
                first = next((k for k in range(x, head) if t[k] not in _MODIFIERS), last)
                kind = f.source(first, last).rstrip("*& ") or None
                if kind is None and f.language != "dart":
                    break
            name = t[last]
            shown = next((w for w in ("public", "protected", "private", "internal") if w in words), {"java": "package-private", "csharp": "private"}.get(f.language))
            shown = access if f.language in ("c", "cpp") else shown or ("private" if name.startswith("_") else "public")
            value = f.source(equals + 1, y) if f.language in ("java", "csharp", "dart") and equals < y and t[equals] == "=" else None
            out.append(_row(owner, name, kind, shown, value, at, len(out)))
    return out


def braced_fields(f, what: str, owner: str, lo: int, hi: int) -> list[dict]:
    """Fields in the body (tokens lo to hi) of a type of a brace language: classes, structs, records and mixins; those of an enum or interface are none."""
    if f.language == "rust":
        return _rust(f, owner, lo, hi) if what in ("struct", "union") else []
    if f.language == "go":
        return _go(f, owner, lo, hi) if what == "struct" else []
    if what not in ("class", "struct", "record", "union", "mixin"):
        return []
    if f.language in _SCRIPTS:
        return _script(f, owner, lo, hi)
    return _typed(f, what, owner, lo, hi) if f.language in ("java", "csharp", "c", "cpp", "dart") else []
