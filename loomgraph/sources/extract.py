"""Facts of one source file. Python by its syntax tree; HTML, CSS and assembly by line and tag scanners; brace languages by
their tokens and scopes; Julia and R by patterns (approximate)."""

from __future__ import annotations

import ast
import re
from html.parser import HTMLParser
from typing import Any

from loomgraph.sources import braced
from loomgraph.sources.fields import python_fields
from loomgraph.sources.languages import SHAPES

MARKERS = r"TODO|FIXME|HACK|SAFETY|XXX|BUG|NOTE|WARNING"
_NOTE = re.compile(rf"(?:#|//|/\*|--|;|<!--)\s*(?:({MARKERS})\b|((?i:{MARKERS}))(?=:)):?\s*(.*)")
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.comprehension, ast.match_case)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


def module_path(path: str, root: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/")
    if parts[-1] == "__init__":
        parts = parts[:-1]
    return ".".join([root, *parts]) if parts else root


#: How a file says which namespace it is in.
_NAMESPACE = {"java": r"^\s*package\s+([\w.]+)\s*;", "csharp": r"^\s*namespace\s+([\w.]+)", "php": r"^\s*(?:<\?php\s+)?namespace\s+([\w\\]+)"}


def module_of(path: str, text: str, root: str, language: str) -> str:
    """A file's module, dotted: the namespace that it declares, else its path below the root's name. Files that stand for their folder have the folder's; a Go file always."""
    if (p := _NAMESPACE.get(language)) and (m := re.search(p, text, re.M)):
        return m[1].replace("\\", ".")
    folder, stem = ([""] + path.rsplit("/", 1))[-2:][0], path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    whole = {"rust": ("mod", "lib"), "typescript": ("index",), "javascript": ("index",)}.get(language, ())
    if stem in whole or language == "go" and folder:
        return ".".join([root, *folder.split("/")]) if folder else root
    return module_path(path, root)


def annotations(text: str) -> list[dict]:
    if not re.search(rf"(?i){MARKERS}", text):
        return []
    return [{"kind": (m[1] or m[2]).upper(), "text": m[3].strip()[:200], "line": i} for i, line in enumerate(text.split("\n"), 1) if (m := _NOTE.search(line))]


def loc(text: str) -> int:
    return text.count("\n") + (1 if text and not text.endswith("\n") else 0)


def generated(text: str) -> bool:
    """A banner in one of the first ten lines that say something, no line break in 1024 bytes or more, or very wide lines."""
    lines = text.split("\n")
    head = [x for x in lines if x.strip()][:10]
    if any(re.search(r"(?i)@generated|do not edit|auto-?generated", x) and re.match(r"\s*(?:#|//|/\*|\*|--|;|<!--)", x) for x in head):
        return True
    first = lines[:50]
    return (len(text) >= 1024 and len(lines) == 1) or (len(first) >= 5 and sum(map(len, first)) / len(first) > 500)


def function(**given: Any) -> dict:
    base = {"name": "", "qualified_name": "", "visibility": "public", "signature": "", "line_number": 1, "end_line": 1, "is_async": False, "is_method": False, "docstring": None, "return_type": None, "decorators": [], "calls": [], "function_refs": [], "references": [], "parameters": [], "branch_count": 0, "param_count": 0, "max_nesting": 0, "is_recursive": False, "procedure_names": [], "nesting_depth": 0, "owner": None, "metadata": {}}
    return base | given


def _dotted(e: ast.AST) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        left = _dotted(e.value)
        return e.attr if left in (None, "self", "cls") else f"{left}.{e.attr}"
    return None


def _within(node: ast.AST):
    """Nodes of a body without those of nested scopes; iterative, so deep expressions are no hazard. (node, nesting)"""
    stack = [(c, 0) for c in ast.iter_child_nodes(node)]
    while stack:
        n, depth = stack.pop()
        yield n, depth
        if not isinstance(n, _SCOPES):
            stack += [(c, depth + isinstance(n, _NESTING)) for c in ast.iter_child_nodes(n)]


def python(path: str, text: str, root: str) -> dict[str, list[dict]]:
    module = module_path(path, root)
    out: dict[str, list[dict]] = {k: [] for k in ("functions", "classes", "constants", "relations", "imports", "fields")}
    tree = ast.parse(text)
    lines = re.findall(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text.encode("utf-8", "replace"))
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out["imports"] += [{"name": a.name, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            out["imports"] += [{"name": base + ("." if n.module else "") + a.name if a.name != "*" else base, "line": n.lineno} for a in n.names]
    stack: list[tuple[ast.AST, list[str], str | None, int]] = [(tree, [], None, 0)]
    while stack:
        node, scope, owner, depth = stack.pop()
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                q = ".".join([module, *scope, n.name])
                out["classes"].append({"name": n.name, "qualified_name": q, "kind": "class", "line_number": n.lineno, "end_line": n.end_lineno, "docstring": ast.get_docstring(n), "decorators": [ast.unparse(d) for d in n.decorator_list], "metadata": {}})
                out["relations"] += [{"source": q, "target": b, "relation": "extends"} for e in n.bases if (b := _dotted(e))]
                out["fields"] += python_fields(n, q, lines)
                stack.append((n, [*scope, n.name], q, depth))
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                q = ".".join([module, *scope, n.name])
                calls, refs, names, branches, deep, called = [], [], [], 0, 0, set()
                for x, level in _within(n):
                    branches += isinstance(x, _BRANCHES)
                    deep = max(deep, level + isinstance(x, _NESTING))
                    if isinstance(x, ast.Call):
                        called.add(id(x.func))
                        if name := _dotted(x.func):
                            calls.append({"name": name, "line": x.lineno})
                        refs += [{"name": r, "line": a.lineno} for a in [*x.args, *(k.value for k in x.keywords)] if isinstance(a, ast.Name | ast.Attribute) and (r := _dotted(a))]
                    elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
                        names.append({"name": x.id, "line": x.lineno})
                a = n.args
                kinds = [*((p, "positional") for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]), *(((a.vararg, "variadic"),) if a.vararg else ()), *(((a.kwarg, "kw_variadic"),) if a.kwarg else ())]
                params = [{"name": p.arg, "type_annotation": ast.unparse(p.annotation) if p.annotation else None, "kind": "receiver" if i == 0 and owner and p.arg in ("self", "cls") else k} for i, (p, k) in enumerate(kinds)]
                doc = ast.get_docstring(n)
                out["functions"].append(function(
                    name=n.name, qualified_name=q, visibility="private" if n.name.startswith("_") and not n.name.startswith("__") else "public", signature=f"def {n.name}({ast.unparse(a)})", line_number=n.lineno, end_line=n.end_lineno,
                    is_async=isinstance(n, ast.AsyncFunctionDef), is_method=owner is not None, docstring=doc, return_type=ast.unparse(n.returns) if n.returns else None, decorators=[ast.unparse(d) for d in n.decorator_list], calls=calls,
                    function_refs=refs, references=names, parameters=params, branch_count=branches, param_count=len(params), max_nesting=deep, is_recursive=any(c["name"].rsplit(".", 1)[-1] == n.name for c in calls),
                    procedure_names=re.findall(r"(?m)^\s*@procedure:\s*(\S+)", doc or ""), nesting_depth=depth, owner=owner,
                ))
                stack.append((n, [*scope, n.name], None, depth + 1))
            elif isinstance(n, ast.Assign | ast.AnnAssign) and not depth:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and (t.id.isupper() or owner or t.id == "urlpatterns"):
                        kind = "attribute" if owner else "constant"
                        out["constants"].append({"name": t.id, "qualified_name": ".".join([module, *scope, t.id]), "kind": kind, "owner": owner, "line_number": n.lineno, "value_preview": ast.unparse(n.value)[: None if t.id == "urlpatterns" else 100] if n.value else None})
            elif not isinstance(n, ast.expr):
                stack.append((n, scope, owner, depth))
    return out


def _block(text: str, at: int, shape) -> int:
    """Where the block that begins behind `at` ends."""
    if shape.block == "end":
        m = re.compile(r"^end\b", re.M).search(text, at)
        return m.end() if m else len(text)
    start = text.find("{", at)
    if start < 0:
        return text.find("\n", at) if "\n" in text[at:] else len(text)
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


_CALL = re.compile(r"(?<![\w.:>])((?:[A-Za-z_]\w*(?:\.|::|->|\?\.))*[A-Za-z_]\w*!?)\s*\(")
_WORDS = {"if", "for", "while", "switch", "return", "catch", "match", "function", "fn", "func", "sizeof", "elseif", "foreach", "new", "await", "and", "or", "not", "in", "typeof", "using", "lock", "when"}
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def patterns(path: str, text: str, root: str, language: str) -> dict[str, list[dict]]:
    """Julia and R, by patterns."""
    shape, module = SHAPES[language], module_of(path, text, root, language)
    out: dict[str, list[dict]] = {k: [] for k in ("functions", "classes", "constants", "relations", "imports")}
    line = lambda at: text.count("\n", 0, at) + 1
    for m in re.finditer(shape.imports, text, re.M):
        out["imports"].append({"name": next(g for g in m.groups() if g), "line": line(m.start())})
    code = _STRINGS.sub(lambda m: '"' + " " * (len(m[0]) - 2) + '"', text)
    code = re.sub(rf"{re.escape(shape.comment)}[^\n]*", lambda m: " " * len(m[0]), code)
    spans = []
    for m in re.finditer(shape.type, text if language == "r" else code, re.M):
        end, q = _block(code, m.end(), shape), shape.separator.join([module, m["name"]])
        spans.append((m.start(), end, m["name"], q))
        groups = m.groupdict()
        kind = groups.get("kind") or "class"
        if kind not in ("impl", "extension"):
            out["classes"].append({"name": m["name"], "qualified_name": q, "kind": kind, "line_number": line(m.start()), "end_line": line(end - 1), "docstring": None})
        if groups.get("base"):
            out["relations"].append({"source": q, "target": groups["base"], "relation": "implements" if kind == "impl" else "extends"})
        out["relations"] += [{"source": q, "target": t.strip(), "relation": "implements"} for t in (groups.get("ifaces") or "").split(",") if t.strip()]
    found = []
    for m in re.finditer(shape.function, code, re.M):
        g = m.groupdict()
        name = g.get("name") or g.get("arrow") or g.get("method")
        if name and name not in _WORDS:
            found.append((m, g, name, _block(code, m.end(), shape)))
    for m, g, name, end in found:
        holder = max((s for s in spans if s[0] < m.start() and end <= s[1]), default=None, key=lambda s: s[0])
        owner = shape.separator.join([module, g["owner"]]) if g.get("owner") else holder[3] if holder else None
        depth = sum(1 for o, _, _, e in found if o.start() < m.start() and end <= e and o is not m)
        body, at = code[m.end() : end], m.end()
        inner = [(o.start(), e) for o, _, _, e in found if m.start() < o.start() and e <= end]
        calls = [{"name": re.sub(r"->|\?\.", ".", c[1]).removeprefix("self.").removeprefix("this."), "line": line(at + c.start())} for c in _CALL.finditer(body) if c[1] not in _WORDS and not any(s <= at + c.start() < e for s, e in inner)]
        params = [p.strip() for p in (g.get("params") or g.get("params2") or g.get("params3") or "").split(",") if p.strip()]
        deep = depth_now = 0
        for c in body:
            depth_now += (c == "{") - (c == "}")
            deep = max(deep, depth_now - 1)
        out["functions"].append(function(
            name=name, qualified_name=shape.separator.join([owner or module, name]), visibility="public" if (g.get("vis") or "").strip() not in ("private", "") else "private", signature=re.sub(r"\s+", " ", text[m.start() : m.end()]).strip(), line_number=line(m.start()), end_line=line(max(m.start(), end - 1)),
            is_method=owner is not None, calls=calls, parameters=[{"name": p, "type_annotation": None, "kind": "positional"} for p in params], param_count=len(params), branch_count=len(re.findall(r"\b(?:if|for|while|case|catch|match|switch)\b|&&|\|\|", body)),
            max_nesting=max(0, deep), is_recursive=any(re.split(r"\.|::", c["name"])[-1] == name for c in calls), nesting_depth=depth, owner=owner,
        ))
    return out


class _Tags(HTMLParser):
    def __init__(self, path: str):
        super().__init__(convert_charrefs=True)
        self.path, self.elements, self.links, self.scripts, self.open, self.in_script, self.head = path, [], [], [], [], None, None

    def handle_starttag(self, tag, attrs):
        a, (row, col) = dict(attrs), self.getpos()
        if tag in ("link", "script", "a", "img") and (to := a.get("href") or a.get("src")):
            self.links.append({"name": to, "line": row, "tag": tag})
        heading = re.fullmatch("h[1-6]", tag)
        if heading or (tag == "form" and "action" in a) or "id" in a:
            e = {"tag": tag, "line_number": row, "column": col, "text": a.get("id") or a.get("action") or "", "parent": self.open[-1]["qualified_name"] if self.open else None}
            e["qualified_name"] = f"{self.path}:{tag}:{row}:{col}:{re.sub(r'[^a-z0-9]+', '-', e['text'].lower()).strip('-')}"
            self.elements.append(e)
            if tag not in ("img", "input", "br", "meta", "link", "hr"):
                self.open.append(e | {"tag": tag})
            if heading:
                self.head = e
        if tag == "script" and "src" not in a:
            self.in_script = row

    def handle_endtag(self, tag):
        if self.open and self.open[-1]["tag"] == tag:
            self.open.pop()
        if self.head and tag == self.head["tag"]:
            self.head = None
        if tag == "script":
            self.in_script = None

    def handle_data(self, data):
        if self.in_script is not None:
            self.scripts.append((self.in_script, data))
        elif self.head is not None and not self.head["text"]:
            self.head["text"] = data.strip()
            self.head["qualified_name"] += re.sub(r"[^a-z0-9]+", "-", data.lower()).strip("-")


def html(path: str, text: str, root: str) -> dict[str, list[dict]]:
    p = _Tags(path)
    p.feed(text)
    out = {"elements": p.elements, "imports": [{"name": x["name"], "line": x["line"]} for x in p.links if x["tag"] in ("link", "script")], "functions": [], "classes": []}
    for row, code in p.scripts:
        inner = braced.braces(path, code, module_of(path, text, root, "html"), "javascript")
        out["functions"] += [f | {"line_number": f["line_number"] + row - 1, "end_line": f["end_line"] + row - 1} for f in inner["functions"]]
    return out


def css(path: str, text: str, root: str) -> dict[str, list[dict]]:
    code = re.sub(r"(?s)/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    rules = [{"name": re.sub(r"\s+", " ", m[1]).strip(), "line_number": code.count("\n", 0, m.start(1)) + 1} for m in re.finditer(r"([^{};@]+)\{", code) if m[1].strip()]
    selectors = [r | {"qualified_name": f"{path}:{r['line_number']}:{r['name']}"} for r in rules]
    constants = [{"name": m[1], "qualified_name": f"{path}:{m[1]}", "kind": "custom_property", "owner": None, "line_number": code.count("\n", 0, m.start()) + 1, "value_preview": m[2].strip()[:100]} for m in re.finditer(r"(--[\w-]+)\s*:\s*([^;}]+)", code)]
    return {"selectors": selectors, "constants": constants, "imports": [{"name": m[1], "line": code.count("\n", 0, m.start()) + 1} for m in re.finditer(r"@import\s+(?:url\()?['\"]?([^'\")\s;]+)", code)]}


#: Operations that pass control, and the way they do.
_TRANSFERS = {"TC": "call", "TCF": "jump", "CALL": "call", "GOTO": "jump", "BZF": "branch", "BZMF": "branch"}
#: How operations use the data that they name.
_ACCESS = {
    op: access
    for access, ops in (
        ("write", "TS"), ("read_write", "XCH DXCH INCR ADS AUG DIM"), ("address", "ADRES CADR FCADR ECADR GENADR BBCON"),
        ("read", "CA CAF CS DCA DCS AD SU MASK MP DV CCS INDEX"),
    )
    for op in ops.split()
}
#: Operations that make their label a datum.
_DATA = ("EQUALS", "=", "ERASE", "OCT", "DEC", "2OCT", "2DEC", "ADRES", "CADR", "ECADR", "GENADR", "VN", "BBCON")
#: Registers; a transfer to one has no target in the text.
_REGISTERS = ("Q", "A", "L", "Z")


def agc(path: str, text: str, root: str) -> dict[str, list[dict]]:
    """Line-oriented: a label in the first column begins a routine; transfers and data references are exact operands."""
    out: dict[str, list[dict]] = {k: [] for k in ("functions", "constants", "transfers", "sites", "imports")}
    current, lines = None, text.split("\n")
    for i, raw in enumerate(lines, 1):
        code = raw.split("#", 1)[0].rstrip()
        if not code.strip():
            continue
        if code.lstrip().startswith("$"):
            out["imports"].append({"name": code.strip()[1:].split()[0], "line": i})
            continue
        parts = code.split()
        label = parts.pop(0) if not code[0].isspace() else None
        op, operand = (parts[0] if parts else ""), (parts[1] if len(parts) > 1 else "")
        if label and op in _DATA:
            out["constants"].append({"name": label, "qualified_name": label, "kind": op, "owner": None, "line_number": i, "value_preview": " ".join(parts[1:])[:100]})
        elif label:
            if current:
                current["end_line"] = i - 1
            current = function(name=label, qualified_name=label, signature=label, line_number=i, end_line=len(lines))
            out["functions"].append(current)
        if current and operand and op in _TRANSFERS:
            kind = _TRANSFERS[op]
            if operand in _REGISTERS:
                kind = "indirect_jump" if kind != "call" or (op, operand) == ("TC", "Q") else "indirect_call"
            out["transfers"].append({"caller": current["qualified_name"], "target": operand, "kind": kind, "line": i})
            if _TRANSFERS[op] == "branch":
                current["branch_count"] += 1
            if operand == current["name"]:
                current["is_recursive"] = True
        elif current and operand and op in _ACCESS:
            out["sites"].append({"caller": current["qualified_name"], "target": operand, "opcode": op, "access": _ACCESS[op], "line": i})
    return out


def extract(path: str, text: str, root: str, language: str) -> dict[str, list[dict]]:
    if language == "python":
        return python(path, text, root)
    if language in ("html", "css", "agc"):
        return {"html": html, "css": css, "agc": agc}[language](path, text, root)
    if language in ("julia", "r"):
        return patterns(path, text, root, language)
    return braced.braces(path, text, module_of(path, text, root, language), language)
