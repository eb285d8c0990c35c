"""Facts of files in brace languages, read from their tokens with a stack of scopes: what stands before a `{` says what it opens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomgraph.sources.fields import braced_fields
from loomgraph.sources.languages import SHAPES
from loomgraph.sources.lexer import Tokens, blanked, tokens

_SCRIPTS = ("typescript", "javascript")
#: The word that begins a function, where a language has one.
_KEYWORD = {"rust": "fn", "go": "func", "swift": "func", "php": "function"}
_TYPES = {
    "rust": ("struct", "enum", "trait", "impl", "union"), "go": (), "java": ("class", "interface", "enum", "record"), "csharp": ("class", "interface", "enum", "struct", "record"),
    "c": ("struct", "enum", "union"), "cpp": ("class", "struct", "enum", "union"), "typescript": ("class", "interface", "enum"), "javascript": ("class",),
    "swift": ("class", "struct", "enum", "protocol", "extension", "actor"), "php": ("class", "interface", "trait", "enum"), "dart": ("class", "mixin", "enum", "extension"),
}
_CONTROL = frozenset("if for while switch return catch match else do try loop unsafe select finally foreach elseif new await typeof using lock when synchronized guard repeat throw sizeof assert defer fixed checked case default in fn func function".split())
#: What counts as a branch, by language: words, and whether a `?` and `default` do.
_BRANCHES = {
    "rust": (("if", "while", "for", "loop"), True, False), "go": (("if", "for", "case"), False, False), "java": (("if", "while", "for", "do", "case", "catch"), True, True),
    "typescript": (("if", "while", "for", "do", "case", "catch"), True, False), "cpp": (("if", "while", "for", "do", "case", "catch"), True, True),
    "csharp": (("if", "while", "for", "foreach", "do", "case", "catch"), True, True), "dart": (("if", "while", "for", "do", "case", "catch"), True, False),
    "swift": (("if", "while", "for", "repeat", "guard", "case", "catch"), True, False), "php": (("if", "elseif", "while", "for", "foreach", "do", "case", "catch"), True, False),
}
_BRANCHES["javascript"], _BRANCHES["c"] = _BRANCHES["typescript"], _BRANCHES["cpp"]
_MODIFIERS = frozenset("public private protected internal static final abstract virtual override async sealed partial readonly const export default extern inline constexpr unsafe mutating open fileprivate pub declare get set explicit friend native synchronized transient volatile late external covariant factory new required".split())
_NAME = re.compile(r"[A-Za-z_$\x80-\U0010ffff][\w$]*$")


@dataclass
class _File:
    language: str
    module: str
    separator: str
    text: str
    tok: Tokens
    lines: list[int]
    out: dict[str, list[dict]] = field(default_factory=lambda: {k: [] for k in ("functions", "classes", "constants", "relations", "imports", "submodules", "fields")})
    skip: dict[int, int] = field(default_factory=dict)  # token where a nested function begins -> token behind it

    def line(self, token: int) -> int:
        import bisect

        at = self.tok.at[min(token, len(self.tok.at) - 1)] if self.tok.at else 0
        return bisect.bisect_right(self.lines, at)

    def source(self, a: int, b: int) -> str:
        t = self.tok
        return re.sub(r"\s+", " ", self.text[t.at[a] : t.at[b - 1] + len(t.text[b - 1])]).strip() if b > a else ""


def _angles(t: list[str], i: int, hi: int) -> int:
    """Behind the `<...>` that begins at i; i itself if it isn't closed soon."""
    depth, at = 0, i
    while at < min(hi, i + 200):
        if t[at] == "<":
            depth += 1
        elif t[at] == ">":
            depth -= 1
            if not depth:
                return at + 1
        elif t[at] in (";", "{", "}", "&&", "||"):
            return i
        at += 1
    return i


def _split(f: _File, lo: int, hi: int, sign: str = ",") -> list[tuple[int, int]]:
    """Ranges between signs outside of brackets."""
    t, out, start, i, angle = f.tok.text, [], lo, lo, 0
    while i < hi:
        if t[i] in "([{":
            i = min(hi, f.tok.pair.get(i, hi))
        elif t[i] == "<":
            i = max(i, _angles(t, i, hi) - 1)
        elif t[i] == sign and not angle:
            out.append((start, i))
            start = i + 1
        i += 1
    return [(a, b) for a, b in [*out, (start, hi)] if b > a]


def _parameters(f: _File, lo: int, hi: int, receiver: tuple[int, int] | None) -> list[dict]:
    out, t = [], f.tok.text
    parts = [(*p, "receiver") for p in ([receiver] if receiver else ())] + [(*p, "positional") for p in _split(f, lo, hi)]
    for a, b, kind in parts:
        if f.language == "dart" and t[a] in "{[":
            out += _parameters(f, a + 1, f.tok.pair.get(a, b), None)
            continue
        while a < b - 1 and t[a] in ("final", "required", "ref", "out", "params", "this") and f.language in ("java", "csharp", "dart", "cpp"):
            a += 1
        variadic = "..." in f.source(a, b)
        equals = next((i for i in range(a, b) if t[i] == "="), b)
        words = [i for i in range(a, equals) if _NAME.match(t[i]) and t[i] not in ("mut", "final", "ref", "out", "in", "params", "const", "this", "readonly", "public", "private", "protected")]
        colon = next((i for i in range(a, equals) if t[i] == ":"), None)
        if t[a:b] and "self" in t[a:b] and f.language == "rust" and not colon:
            out.append({"name": "self", "type_annotation": None, "kind": "receiver"})
            continue
        if f.language in ("rust", "typescript", "javascript", "swift"):
            end = colon if colon is not None else equals
            names = [i for i in words if i < end]
            name, kind_of = (t[names[-1]] if names else f.source(a, end)), f.source(colon + 1, equals) if colon is not None else ""
        elif f.language == "go":
            name, kind_of = (t[words[0]], f.source(words[0] + 1, b)) if len(words) > 1 or words and equals - a > 1 and t[a] == t[words[0]] else ("", f.source(a, b))
        else:
            last = words[-1] if words else None
            alone = last is None or f.source(a, last) == ""
            name, kind_of = ("", f.source(a, equals)) if last is None else (t[last], "" if alone else f.source(a, last))
            if alone and f.language in ("c", "cpp"):
                name, kind_of = "", f.source(a, equals)
            if f.language in ("c", "cpp") and (m := re.search(r"\(\s*\*\s*(\w+)\s*\)", f.source(a, equals))):
                name, kind_of = m[1], f.source(a, equals).replace(m[1], "", 1)
        if kind_of or name:
            out.append({"name": name, "type_annotation": kind_of or None, "kind": "variadic" if variadic and kind == "positional" else kind})
    if f.language == "go":  # a, b int
        for one, after in zip(reversed(out[:-1]), reversed(out[1:]), strict=True):
            if not one["name"] and after["name"] and _NAME.match(one["type_annotation"]):
                one["name"], one["type_annotation"] = one["type_annotation"], after["type_annotation"]
    return [p for p in out if (p["name"], p["type_annotation"]) != ("", "void")]


@dataclass
class _Head:
    name: str
    start: int  # of the whole head
    open: int  # the bracket of the parameters
    owner: str | None = None
    receiver: tuple[int, int] | None = None
    returns: str | None = None


def _type_before(f: _File, a: int, b: int) -> str | None:
    words = [i for i in range(a, b) if f.tok.text[i] not in _MODIFIERS]
    return f.source(words[0], b) if words else None


def _function_head(f: _File, a: int, b: int, owner: str | None, depth: int) -> _Head | None:
    """What tokens a to b, which stand before a body, say of a function; None if they begin none."""
    whole = a
    head = _bare_head(f, a, b, owner, depth)
    if head:
        head.start = whole
    return head


def _bare_head(f: _File, a: int, b: int, owner: str | None, depth: int) -> _Head | None:
    t, pair = f.tok.text, f.tok.pair
    while a < b and (t[a] in ("@", "#") or t[a] == "[" and f.language in ("csharp", "cpp")):  # annotations and attributes
        i = pair.get(a, b) if t[a] == "[" else a + 1
        while t[a] != "[" and i < b and (_NAME.match(t[i]) or t[i] in (".", "[")):
            i = pair.get(i, b) + 1 if t[i] == "[" else i + 1
            if i < b and t[i] == "(":
                i = pair.get(i, b) + 1
                break
            if i < b and t[i - 1] != "." and t[i] != ".":
                break
        a = i + 1 if t[a] == "[" else max(i, a + 1)
    if a >= b:
        return None
    if f.language in _SCRIPTS:
        return _script_head(f, a, b, owner, depth)
    keyword = _KEYWORD.get(f.language)
    i = a
    if keyword:
        while i < b and t[i] != keyword and not (f.language == "swift" and t[i] == "init" and i + 1 < b and t[i + 1] in "(?<"):
            i = pair.get(i, b) + 1 if t[i] in "([" else i + 1
        if i >= b:
            return None
        head = _Head("init", a, i) if t[i] == "init" else _Head("", a, i)
        i += 1
        if f.language == "go" and i < b and t[i] == "(" and pair.get(i, b) + 1 < b and _NAME.match(t[pair[i] + 1]):
            head.receiver, i = (i + 1, pair[i]), pair[i] + 1
            named = [x for x in t[head.receiver[0] : head.receiver[1]] if _NAME.match(x)]
            head.owner = named[1] if len(named) > 1 and t[head.receiver[0]] == named[0] and t[head.receiver[0] + 1] not in ("[", ".") else named[0] if named else None
        if f.language == "php" and i < b and t[i] == "&":
            i += 1
        if not head.name:
            if i >= b or not _NAME.match(t[i]):
                return None
            head.name, i = t[i], i + 1
        if i < b and t[i] == "<":
            i = _angles(t, i, b)
        elif i < b and t[i] == "[" and f.language == "go":
            i = pair.get(i, b) + 1
        if i < b and t[i] == "?":
            i += 1
        if i >= b or t[i] != "(":
            return None
        head.open = i
        end = pair.get(i, b)
        if f.language == "go":
            head.returns = f.source(end + 1, b) or None
        elif f.language == "php":
            head.returns = f.source(end + 2, b) or None if end + 1 < b and t[end + 1] == ":" else None
        else:
            arrow = next((k for k in range(end + 1, b) if t[k] == "->"), None)
            stop = next((k for k in range(end + 1, b) if t[k] == "where"), b)
            head.returns = f.source(arrow + 1, stop) if arrow is not None and arrow < stop else None
        return head
    if t[a] in _CONTROL and t[a] not in ("new", "default") or depth and f.language != "csharp":
        return None
    while i < b and t[i] != "(":  # the first bracket behind a name
        if t[i] in ("=", "new"):
            return None
        i = max(i + 1, _angles(t, i, b)) if t[i] == "<" else pair.get(i, b) + 1 if t[i] == "[" else i + 1
    if i >= b or i == a:
        return None
    name = i - 1
    if t[name] == ">":  # a generic method's own parameters
        name = next((k for k in range(name, a - 1, -1) if t[k] == "<" and _angles(t, k, b) == i), a) - 1
    if name < a or not _NAME.match(t[name]) or t[name] in _CONTROL:
        return None
    first = name
    text = t[name]
    if first > a and t[first - 1] == "~":
        first, text = first - 1, "~" + text
    given = None
    if first - 1 > a and t[first - 1] == "::" and _NAME.match(t[first - 2]):
        given, first = t[first - 2], first - 2
        while first - 2 >= a and t[first - 1] == "::" and _NAME.match(t[first - 2]):
            first -= 2
    elif first - 1 == a + 0 and t[first - 1] == "::":
        return None
    returns = _type_before(f, a, first)
    short = owner and re.split(r"::|[.\\]", owner)[-1]
    if returns is None and text.lstrip("~") not in (short, given) and not (f.language == "java" and short):
        return None
    if returns and t[a] in ("return", "throw", "else"):
        return None
    return _Head(text, a, i, given, None, returns)


def _script_head(f: _File, a: int, b: int, owner: str | None, depth: int) -> _Head | None:
    t, pair = f.tok.text, f.tok.pair
    for i in range(b - 1, a - 1, -1):
        if t[i] == "function" and (i == a or t[i - 1] not in (".",)):
            k = i + 2 if i + 1 < b and t[i + 1] == "*" else i + 1
            if k < b and _NAME.match(t[k]):
                name, k = t[k], k + 1
            else:
                named = next((x for x in range(i - 1, a, -1) if t[x] in ("=", ":")), None)
                if named is None or not _NAME.match(t[named - 1]):
                    return None
                name = t[named - 1]
            k = _angles(t, k, b) if k < b and t[k] == "<" else k
            if k >= b or t[k] != "(":
                return None
            return _Head(name, a, k, returns=_script_return(f, pair.get(k, b), b))
    if t[b - 1] == "=>":
        i = b - 2
        if t[i] != ")":  # x => or (x): T =>
            close = next((k for k in range(i, a, -1) if t[k] == ")"), None)
            if close is not None and t[close + 1 : close + 2] == [":"]:
                i = close
        open_ = pair.get(i, i) if t[i] == ")" else i
        before = open_ - 1
        if before > a and t[before] == ">":
            before = next((k for k in range(before, a, -1) if t[k] == "<" and _angles(t, k, b) == before + 1), before) - 1
        if before > a and t[before] == "async":
            before -= 1
        if before <= a or t[before] != "=":
            return None
        kind = next((k for k in range(before - 1, a - 1, -1) if t[k] in ("const", "let", "var")), None)
        name = kind + 1 if kind is not None else next((k for k in range(before - 1, a - 1, -1) if t[k] == ":"), before) - 1
        if not _NAME.match(t[name]) or name > a and t[name - 1] == ".":
            return None
        return _Head(t[name], a, open_ if t[open_] == "(" else -1 - open_, returns=_script_return(f, i, b - 1) if t[i] == ")" else None)
    if depth and not owner:
        return None
    i = a
    while i < b and t[i] in _MODIFIERS | {"*", "#"} and not (i + 1 < b and t[i + 1] == "("):
        i += 1
    if i >= b or not (_NAME.match(t[i]) or t[i] == '"') or t[i] in _CONTROL:
        return None
    k = _angles(t, i + 1, b) if i + 1 < b and t[i + 1] == "<" else i + 1
    if k >= b or t[k] != "(" or not owner:
        return None
    end = pair.get(k, b)
    if end + 1 < b and t[end + 1] != ":":
        return None
    return _Head(t[i], a, k, returns=_script_return(f, end, b))


def _script_return(f: _File, close: int, b: int) -> str | None:
    return f.source(close + 2, b) or None if close + 1 < b and f.tok.text[close + 1] == ":" else None


def _type_head(f: _File, a: int, b: int) -> tuple[str, str, list[tuple[str, str]]] | None:
    """(kind, name, (relation, target) of each base) of a type's head."""
    t = f.tok.text
    words = _TYPES[f.language]
    if f.language == "go":
        return (t[b - 1], t[a + 1], []) if b - a >= 3 and t[a] == "type" and t[b - 1] in ("struct", "interface") else None
    i = a
    while i < b and t[i] not in words:
        if t[i] in ("=", "return", "(") and not (t[i] == "(" and t[a] in ("@", "pub", "#")):
            return None
        i = f.tok.pair.get(i, b) + 1 if t[i] in "([" else i + 1
    if i >= b:
        return None
    kind = t[i]
    i += 1
    if kind == "impl":
        i = _angles(t, i, b) if i < b and t[i] == "<" else i
        stop = next((k for k in range(i, b) if t[k] == "where"), b)
        to = next((k for k in range(i, stop) if t[k] == "for" and t[k + 1 : k + 2] != ["<"]), None)
        own, base = (to + 1, (i, to)) if to is not None else (i, None)
        name = _base_name(f, own, stop)
        return (kind, name, [("implements", _base_name(f, *base))] if base else []) if name else None
    if kind == "enum" and i < b and t[i] in ("class", "struct") or kind == "record" and i < b and t[i] in ("struct", "class"):
        i += 1
    while i + 1 < b and (t[i] == "[" or f.language in ("c", "cpp") and t[i].isupper() and _NAME.match(t[i + 1])):  # attributes and export macros
        i = f.tok.pair.get(i, b) + 1 if t[i] == "[" else i + 1
    if i >= b or not _NAME.match(t[i]) or (f.language in ("c", "cpp") and any(x in ("(", "=") for x in t[i:b])):
        return None
    name, i = t[i], i + 1
    bases: list[tuple[str, str]] = []
    relation = None
    while i < b:
        if t[i] == "<":
            i = max(i + 1, _angles(t, i, b))
            continue
        if t[i] in ("extends", "implements", "with", "on", ":", "where", "permits"):
            relation = {"extends": "extends", "implements": "implements", "with": "implements", "on": "extends", ":": "extends"}.get(t[i])
            end = next((k for k in range(i + 1, b) if t[k] in ("extends", "implements", "with", "where", "permits")), b)
            if relation and f.language != "rust":
                for n, (x, y) in enumerate(_split(f, i + 1, end)):
                    if base := _base_name(f, x, y):
                        bases.append(("implements" if n and t[i] == ":" and f.language in ("csharp", "swift") else relation, base))
            i = end
            continue
        i = f.tok.pair.get(i, b) + 1 if t[i] in "([" else i + 1
    return kind, name, bases


def _base_name(f: _File, a: int, b: int) -> str:
    """A type's name without generics and access words."""
    t, out, i = f.tok.text, "", a
    while i < b:
        if t[i] == "<" or t[i] == "(":
            break
        if t[i] in ("::", ".", "\\") or _NAME.match(t[i]) and t[i] not in ("public", "private", "protected", "virtual", "dyn", "mut", "const"):
            if out and _NAME.match(t[i]) and out[-1] not in ":.\\":
                break
            out += t[i]
        i += 1
    return out.strip(":.\\")


def _calls(f: _File, lo: int, hi: int) -> list[dict]:
    t, out, i = f.tok.text, [], lo
    while i < hi:
        if i in f.skip:
            i = f.skip[i]
            continue
        if t[i] == "(" and i > lo:
            k = i - 1
            if t[k] == ">":
                k = next((x for x in range(k, max(lo, k - 60), -1) if t[x] == "<" and _angles(t, x, hi) == i), k) - 1
                k -= t[k] == "::"
            macro = t[k] == "!" and f.language == "rust"
            k -= macro
            if t[k] == "?." and f.language in _SCRIPTS:
                k -= 1
            if k >= lo and _NAME.match(t[k]) and (t[k] not in _CONTROL or t[k - 1] in (".", "->", "::")) and not (k and t[k - 1] in ("function", "fn", "func")):
                name, x = t[k] + "!" * macro, k
                while x - 2 >= lo and t[x - 1] in (".", "::", "->", "?.") and (_NAME.match(t[x - 2])):
                    name, x = t[x - 2] + ("::" if t[x - 1] == "::" else ".") + name, x - 2
                name = re.sub(r"^(?:self|this|\$this|Self|super|static|parent)(?:\.|::)", "", name)
                out.append({"name": name, "line": f.line(k)})
        i += 1
    return out


def _statement(f: _File, i: int, hi: int) -> int:
    """Behind the statement that begins at i."""
    t, pair = f.tok.text, f.tok.pair
    if i >= hi:
        return hi
    if t[i] == "{":
        return min(hi, pair.get(i, hi) + 1)
    if t[i] in ("if", "for", "while", "foreach", "switch", "do", "try", "else", "guard", "loop", "match", "repeat"):
        return _construct(f, i, hi)
    while i < hi and t[i] != ";":
        i = min(hi, pair.get(i, hi) + 1) if t[i] in "([{" else i + 1
    return min(hi, i + 1)


def _construct(f: _File, i: int, hi: int) -> int:
    """Behind the control structure that begins at i, with its else part."""
    t, pair, word = f.tok.text, f.tok.pair, f.tok.text[i]
    at = i + 1
    if word in ("do", "repeat"):
        at = _statement(f, at, hi)
        while at < hi and t[at] != ";" and t[at] != "}":
            at = min(hi, pair.get(at, hi) + 1) if t[at] in "([" else at + 1
            if t[at - 1] == ")" or at >= hi:
                break
        return at
    if f.language in ("rust", "go", "swift") or word in ("catch", "try", "loop", "match") and at < hi and t[at] != "(":
        while at < hi and t[at] != "{" and not (t[at] == ";" and f.language == "rust"):
            at = min(hi, pair.get(at, hi) + 1) if t[at] in "([" else at + 1
        at = min(hi, pair.get(at, hi) + 1) if at < hi and t[at] == "{" else at
    else:
        while at < hi and t[at] in ("await", "constexpr"):
            at += 1
        if at < hi and t[at] == "(":
            at = min(hi, pair.get(at, hi) + 1)
        at = _statement(f, at, hi)
    if word in ("if", "elseif") and at < hi and t[at] == ";" and at + 1 < hi and t[at + 1] == "else":
        at += 1
    if word in ("if", "elseif") and at < hi and t[at] in ("else", "elseif"):
        at = _statement(f, at + 1, hi) if t[at] == "else" else _construct(f, at, hi)
    return at


def _arms(f: _File, lo: int, hi: int) -> list[tuple[int, int]]:
    """The arms of a Rust match, patterns and bodies together."""
    t, pair, out, start, i = f.tok.text, f.tok.pair, [], lo, lo
    while i < hi:
        if t[i] == "=>":
            i = min(hi, pair.get(i + 1, hi) + 1) if t[i + 1 : i + 2] == ["{"] else i + 1
            while i < hi and t[i] != "," and t[i - 1] != "}":
                i = min(hi, pair.get(i, hi) + 1) if t[i] in "([{" else i + 1
            i += i < hi and t[i] == ","
            out.append((start, i))
            start = i
        else:
            i = min(hi, pair.get(i, hi) + 1) if t[i] in "([{" else i + 1
    return out


def _ternary(f: _File, i: int, hi: int) -> int:
    """Behind the conditional expression whose `?` stands at i; 0 if it is no such sign."""
    t, colon, i = f.tok.text, False, i + 1
    while i < hi and t[i] not in (";", ",", ")", "]", "}"):
        colon = colon or t[i] == ":"
        i = min(hi, f.tok.pair.get(i, hi) + 1) if t[i] in "([{" else i + 1
    return i if colon else 0


def _complexity(f: _File, lo: int, hi: int) -> tuple[int, int]:
    """Branches, and how deep they stand in each other; nested functions have their own."""
    t, pair = f.tok.text, f.tok.pair
    words, question, default = _BRANCHES[f.language]
    count = deepest = 0
    todo = [(lo, hi, 0)]
    while todo:
        i, end, depth = todo.pop()
        while i < end:
            if i in f.skip:
                i = f.skip[i]
                continue
            x, stop, inner = t[i], 0, None
            if x in words and not (i and t[i - 1] in (".", "->", "?.", "::")):
                if x == "case":
                    stop = i + 1
                    while f.language != "java" and stop < end and t[stop] not in ("case", "default"):
                        stop = min(end, pair.get(stop, end) + 1) if t[stop] in "([{" else stop + 1
                elif not (x == "for" and t[i + 1 : i + 2] == ["<"]):
                    stop = _construct(f, i, end)
                    inner = _statement(f, i + 1, end) if x in ("do", "repeat") else None
            elif x == "default" and default and t[i + 1 : i + 2] in ([":"], ["->"]):
                stop = i + 1
            elif x == "?" and f.language == "rust":
                count, deepest = count + 1, max(deepest, depth + 1)
            elif x == "?" and question:
                stop = _ternary(f, i, end)
            elif x == "match" and f.language == "rust":
                open_ = i + 1
                while open_ < end and t[open_] != "{":
                    open_ = min(end, pair.get(open_, end) + 1) if t[open_] in "([" else open_ + 1
                close = min(end, pair.get(open_, end))
                arms = _arms(f, open_ + 1, close)
                todo += [(i + 1, open_, depth), *((a, b, depth + 1) for a, b in arms)]
                count, deepest, i = count + len(arms), max(deepest, depth + bool(arms)), close + 1
                continue
            if stop:
                count, deepest = count + 1, max(deepest, depth + 1)
                todo.append((i + 1, inner or stop, depth + 1))
            i = max(i + 1, stop)
    return count, deepest


def _lambdas(f: _File) -> None:
    """Bodies of functions without a name are skipped by what counts for the function around them."""
    t, pair = f.tok.text, f.tok.pair
    for i, x in enumerate(t):
        if x == "=>" and f.language in (*_SCRIPTS, "dart", "csharp") or x == "->" and f.language == "java":
            if t[i + 1 : i + 2] == ["{"] and t[i - 1] in (")",) + ((t[i - 1],) if _NAME.match(t[i - 1]) else ()):
                f.skip.setdefault(i + 1, pair.get(i + 1, len(t)) + 1)
        elif x == "func" and f.language == "go" and t[i + 1 : i + 2] == ["("]:
            k = pair.get(i + 1, len(t)) + 1
            while k < len(t) and t[k] not in ("{", ";"):
                k = pair.get(k, len(t)) + 1 if t[k] in "([" else k + 1
            if k < len(t) and t[k] == "{":
                f.skip.setdefault(k, pair.get(k, len(t)) + 1)
        elif x == "{" and f.language == "cpp" and i and t[i - 1] == ")" and (o := pair.get(i - 1, 0)) and t[o - 1] == "]":
            f.skip.setdefault(i, pair.get(i, len(t)) + 1)
        elif x == "{" and f.language == "rust" and i and t[i - 1] in ("|", "||"):
            f.skip.setdefault(i, pair.get(i, len(t)) + 1)


def _decorators(f: _File, a: int, b: int) -> list[str]:
    """`@name(...)` before a definition, and attributes in brackets."""
    t, out, i = f.tok.text, [], a
    while i < b:
        if t[i] == "@" and f.language not in ("c", "cpp") and i + 1 < b and _NAME.match(t[i + 1]) and t[i + 1] != "interface":
            k = i + 2
            while k + 1 < b and t[k] == ".":
                k += 2
            k = min(b, f.tok.pair.get(k, b) + 1) if k < b and t[k] == "(" else k
            out.append(f.source(i + 1, k))
            i = k
        elif t[i] == "#" and t[i + 1 : i + 2] == ["["]:
            k = f.tok.pair.get(i + 1, b)
            out.append(f.source(i + 2, k))
            i = k + 1
        else:
            i = f.tok.pair.get(i, b) + 1 if t[i] in "([" else i + 1
    return out


def _visibility(f: _File, head: _Head) -> str:
    words = f.tok.text[head.start : max(head.start, head.open)]
    for x in ("private", "fileprivate", "protected", "public", "internal", "pub", "open"):
        if x in words:
            return {"fileprivate": "private", "pub": "public", "open": "public"}.get(x, x)
    if f.language == "go":
        return "public" if head.name[:1].isupper() else "private"
    if f.language == "dart":
        return "private" if head.name.startswith("_") else "public"
    return "public" if f.language in ("typescript", "javascript", "php", "c", "cpp") else "private" if f.language in ("rust", "java", "csharp") else "internal"


def _scope(f: _File, top: int, bottom: int) -> None:
    """Definitions between two tokens, those in bodies too: the stack holds (from, to, qualified owner, function depth, name of the scope)."""
    from loomgraph.sources.extract import function

    t, pair, sep = f.tok.text, f.tok.pair, f.separator
    found: list[tuple[dict, int, int]] = []
    todo: list[tuple[int, int, str | None, int, str]] = [(top, bottom, None, 0, f.module)]
    exposed: list[tuple[int, int]] = []  # blocks of methods that Python sees
    while todo:
        lo, hi, owner, depth, scope = todo.pop()
        start = i = lo
        while i < hi:
            x = t[i]
            if x in ";}" or x == "," and owner and f.language in ("php", "dart"):
                start = i = i + 1
                continue
            if x in "([":
                end = min(hi, pair.get(i, hi))
                todo.append((i + 1, end, None if depth else owner, depth + (not owner) if depth else depth, scope)) if x == "(" and "{" in t[i + 1 : end] else None
                i = end + 1
                continue
            if x == "=>" and f.language in (*_SCRIPTS, "dart", "csharp") and t[i + 1 : i + 2] != ["{"]:  # an expression is the body
                stop = i + 1
                while stop < hi and t[stop] not in (";", "}") and not (t[stop] == "," and not depth):
                    stop = min(hi, pair.get(stop, hi) + 1) if t[stop] in "([{" else stop + 1
                head = _function_head(f, start, i + (f.language in _SCRIPTS), owner, depth)
                if head:
                    _add(f, found, function, head, i + 1, stop, owner, depth, scope)
                    start = i = stop
                    continue
            if x != "{":
                i += 1
                start = i if x == ":" and f.language == "cpp" and t[i - 2] in ("public", "private", "protected") else start  # an access label
                continue
            end = min(hi, pair.get(i, hi))
            if f.language == "cpp" and i > start + 1 and _NAME.match(t[i - 1]) and t[i - 2] in (",", ":") and ")" in t[start:i]:  # y{2} among a constructor's initializers
                i = end + 1
                continue
            kind = _type_head(f, start, i)
            head = None if kind else _function_head(f, start, i, owner, depth)
            if kind:
                what, name, bases = kind
                q = sep.join([scope, name])
                if what not in ("impl", "extension"):
                    f.out["classes"].append({"name": name, "qualified_name": q, "kind": what, "line_number": f.line(_first(f, start, i)), "end_line": f.line(end), "docstring": None, "decorators": (marks := _decorators(f, start, i)), "metadata": _seen_type(f, marks)})
                    f.out["fields"] += braced_fields(f, what, q, i + 1, end)
                elif f.language == "rust" and "pymethods" in _decorators(f, start, i):
                    exposed.append((i, end))
                f.out["relations"] += [{"source": q, "target": base, "relation": relation} for relation, base in bases]
                todo.append((i + 1, end, q, 0, q))
            elif head:
                q = _add(f, found, function, head, i + 1, end, owner, depth, scope)
                f.skip[i] = end + 1
                todo.append((i + 1, end, None, depth + 1, q))
            else:
                space = t[start + 1] if t[start : start + 1] == ["namespace"] and f.language == "cpp" and start + 1 < i else t[i - 1] if f.language == "rust" and i - 2 >= start and t[i - 2] == "mod" else None
                todo.append((i + 1, end, None if depth else owner, depth, sep.join([scope, space]) if space else scope))
            start = i = end + 1
    _lambdas(f)
    for one, lo, hi in found:
        skipped = f.skip.pop(lo - 1, None)
        one["calls"] = _calls(f, lo, hi)
        one["branch_count"], one["max_nesting"] = _complexity(f, lo, hi)
        if f.language == "rust":
            _seen_function(one, one["nesting_depth"] == 0 and any(a < lo <= b for a, b in exposed))
        one["is_recursive"] = any(re.split(r"\.|::", c["name"])[-1] == one["name"] for c in one["calls"])
        if skipped is not None:
            f.skip[lo - 1] = skipped
        f.out["functions"].append(one)


def _python_name(marks: list[str], which: str) -> dict[str, str]:
    told = next((m for x in marks if x.startswith(which) and (m := re.search(r'name\s*=\s*"([^"]+)"', x))), None)
    return {"py_name": told[1]} if told else {}


def _seen_type(f: _File, marks: list[str]) -> dict[str, str]:
    """What the attributes of a Rust type say about Python."""
    return {"is_pyclass": "true"} | _python_name(marks, "pyclass") if f.language == "rust" and any(x.startswith("pyclass") for x in marks) else {}


def _seen_function(one: dict, in_methods: bool) -> None:
    """What the attributes of a Rust function, or those of the block around it, say about Python and C."""
    marks, told = one["decorators"], {}
    python, foreign = in_methods or any(re.match(r"(?:pyfunction|new)\b", x) for x in marks), any("no_mangle" in x for x in marks)
    if python or foreign:
        told = {"is_ffi": "true", "ffi_kind": "pyo3" if python else "extern_c"} | _python_name(marks, "pyfunction")
    if python:
        told["is_pymethod"] = "true"
        one["visibility"] = "pub(py)" if one["visibility"] == "private" else one["visibility"]
    if any(re.match(r"pymodule\b", x) for x in marks):
        told |= {"is_pymodule": "true", "is_ffi": "true", "ffi_kind": "pyo3"}
    one["metadata"] = told


def _first(f: _File, a: int, b: int) -> int:
    """The token where a definition begins, behind its annotations."""
    i, t = a, f.tok.text
    while i < b and t[i] in ("@", "#"):
        i += 1
        while i < b and (_NAME.match(t[i]) and t[i - 1] in ("@", ".", "#") or t[i] in ("(", "[", ".")):
            i = f.tok.pair.get(i, b) + 1 if t[i] in "([" else i + 1
    return min(i, b)


def _add(f: _File, found: list, function, head: _Head, lo: int, hi: int, owner: str | None, depth: int, scope: str) -> str:
    t, sep = f.tok.text, f.separator
    of = sep.join([f.module, head.owner]) if head.owner else owner if not depth else None
    q = sep.join([of or scope, head.name])
    if head.open >= 0:
        params = _parameters(f, head.open + 1, f.tok.pair.get(head.open, lo), head.receiver)
    else:
        params = [{"name": t[-1 - head.open], "type_annotation": None, "kind": "positional"}]
    first = _first(f, head.start, lo)
    found.append((function(
        name=head.name, qualified_name=q, visibility=_visibility(f, head), signature=f.source(first, lo - 1), line_number=f.line(first), end_line=f.line(min(hi, len(t) - 1)), is_async="async" in t[head.start : lo], is_method=of is not None,
        return_type=head.returns, decorators=_decorators(f, head.start, lo), parameters=params, param_count=len(params), nesting_depth=depth, owner=of,
    ), lo, hi))
    return q


def braces(path: str, text: str, module: str, language: str) -> dict[str, list[dict]]:
    shape = SHAPES[language]
    code = blanked(text, language)
    if language == "c" or language == "cpp":
        code = re.sub(r"(?m)^([ \t]*template[ \t]*<[^;{}]*?>)", lambda m: " " * len(m[0]), code)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    f = _File(language, module, shape.separator, text, tokens(code, language), starts)
    for m in re.finditer(shape.imports, text, re.M):
        if code[m.start() : m.end()].strip() or language in ("c", "cpp"):
            f.out["imports"].append({"name": next(g for g in m.groups() if g), "line": text.count("\n", 0, m.start()) + 1})
    if language == "rust":
        f.out["submodules"] = re.findall(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", code)
    _scope(f, 0, len(f.tok.text))
    f.out["functions"].sort(key=lambda x: (x["line_number"], x["qualified_name"]))
    f.out["classes"].sort(key=lambda x: x["line_number"])
    return f.out
