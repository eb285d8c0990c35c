"""A read-only Cypher subset, compiled to DataFrame operations.

MATCH, OPTIONAL MATCH, WHERE, WITH, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT and CALL ... YIELD; inline properties, edge type
alternatives, either direction, bounded variable length with trail semantics, EXISTS { }, parameters, named paths.

A pattern starts at its most selective end. A node of known label that nothing asks about isn't joined. When only
distinct ends of a variable-length pattern are asked for, it is expanded as a frontier of distinct pairs, not as paths."""

from __future__ import annotations

import itertools
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import settled
from loomgraph.operators import graph as G
from loomgraph.operators import procedures
from loomgraph.operators.graph import PropertyGraph

_TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<par>\$\w+)|(?P<op>\.\.|<=|>=|<>|=~|[-+*/%=<>()\[\]{}:,.|])""")
_AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}


class CypherError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.t, self.i, self.new = _tokens(text), 0, itertools.count()

    def peek(self, k: int = 0) -> str:
        return self.t[min(self.i + k, len(self.t) - 1)][1]

    def word(self, *words: str) -> bool:
        """Are these keywords next? If so, they're taken."""
        if all(self.t[min(self.i + k, len(self.t) - 1)][0] == "name" and self.peek(k).upper() == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def ahead(self, *words: str) -> bool:
        at = self.i
        found = self.word(*words)
        self.i = at
        return found

    def take(self, op: str) -> bool:
        if self.t[self.i][0] == "op" and self.peek() == op:
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise CypherError(f"expected {op!r}, found {self.peek()!r}")

    def name(self) -> str:
        kind, x = self.t[self.i]
        if kind != "name":
            raise CypherError(f"expected a name, found {x!r}")
        self.i += 1
        return x.strip("`")

    # expressions, as tuples

    def expr(self):
        x = self.xand()
        while self.word("OR"):
            x = ("or", x, self.xand())
        return x

    def xand(self):
        x = self.xnot()
        while self.word("AND"):
            x = ("and", x, self.xnot())
        return x

    def xnot(self):
        return ("not", self.xnot()) if self.word("NOT") else self.compare()

    def compare(self):
        x = self.add()
        while True:
            if self.word("STARTS", "WITH"):
                x = ("starts", x, self.add())
            elif self.word("ENDS", "WITH"):
                x = ("ends", x, self.add())
            elif self.word("CONTAINS"):
                x = ("contains", x, self.add())
            elif self.word("IN"):
                x = ("in", x, self.add())
            elif self.word("IS", "NOT", "NULL"):
                x = ("notnull", x)
            elif self.word("IS", "NULL"):
                x = ("null", x)
            elif self.t[self.i][0] == "op" and self.peek() in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                op = self.peek()
                self.i += 1
                x = (op, x, self.add())
            else:
                return x

    def add(self):
        x = self.mul()
        while self.peek() in ("+", "-") and self.t[self.i][0] == "op":
            op = self.peek()
            self.i += 1
            x = (op, x, self.mul())
        return x

    def mul(self):
        x = self.unary()
        while self.peek() in ("*", "/", "%") and self.t[self.i][0] == "op":
            op = self.peek()
            self.i += 1
            x = (op, x, self.unary())
        return x

    def unary(self):
        return ("neg", self.unary()) if self.take("-") else self.postfix()

    def postfix(self):
        x = self.primary()
        while True:
            if self.take("."):
                x = ("prop", x, self.name())
            elif self.take("["):
                x = ("index", x, self.expr())
                self.need("]")
            else:
                return x

    def primary(self):
        kind, x = self.t[self.i]
        if kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), x[1:-1]))
        if kind == "num":
            self.i += 1
            return ("lit", float(x) if "." in x else int(x))
        if kind == "par":
            self.i += 1
            return ("param", x[1:])
        if self.take("("):
            x = self.expr()
            self.need(")")
            return x
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if self.take("{"):
            return ("map", self.map_rest())
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.word(word):
                return ("lit", value)
        if self.ahead("EXISTS") and self.peek(1) == "{":
            self.i += 2
            self.word("MATCH")
            patterns = self.patterns()
            where = self.expr() if self.word("WHERE") else None
            self.need("}")
            return ("exists", patterns, where)
        name = self.name()
        if self.take("("):
            distinct, args = self.word("DISTINCT"), []
            if self.take("*"):
                self.need(")")
                return ("call", name.lower(), False, [("star",)])
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return ("call", name.lower(), distinct, args)
        return ("var", name)

    def map_rest(self) -> dict:
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            self.take(",")
        return out

    # patterns

    def patterns(self) -> list[dict]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def path(self) -> dict:
        named = None
        if self.t[self.i][0] == "name" and self.peek(1) == "=":
            named = self.name()
            self.need("=")
        nodes, edges = [self.node()], []
        while self.peek() in ("-", "<"):
            edges.append(self.edge())
            nodes.append(self.node())
        return {"name": named, "nodes": nodes, "edges": edges}

    def node(self) -> dict:
        self.need("(")
        var = self.name() if self.t[self.i][0] == "name" else None
        label = self.name() if self.take(":") else None
        props = self.map_rest() if self.take("{") else {}
        self.need(")")
        return {"var": var or f"_n{next(self.new)}", "anonymous": var is None, "label": label, "props": props}

    def edge(self) -> dict:
        left = self.take("<")
        self.need("-")
        out = {"var": f"_r{next(self.new)}", "types": (), "props": {}, "hops": None}
        if self.take("["):
            if self.t[self.i][0] == "name":
                out["var"] = self.name()
            if self.take(":"):
                types = [self.name()]
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
                out["types"] = tuple(types)
            if self.take("*"):
                low = int(self.t[self.i][1]) if self.t[self.i][0] == "num" else None
                self.i += low is not None
                if self.take(".."):
                    if self.t[self.i][0] != "num":
                        raise CypherError("a variable-length pattern needs an upper bound")
                    high = int(self.t[self.i][1])
                    self.i += 1
                    out["hops"] = (1 if low is None else low, high)
                elif low is None:
                    raise CypherError("a variable-length pattern needs an upper bound")
                else:
                    out["hops"] = (low, low)
            if self.take("{"):
                out["props"] = self.map_rest()
            self.need("]")
        self.need("-")
        right = self.take(">")
        out["dir"] = "in" if left and not right else "out" if right and not left else "both"
        return out

    # clauses

    def items(self) -> list[tuple[Any, str]]:
        out = []
        while True:
            start = self.i
            e = self.expr()
            text = "".join(x for _, x in self.t[start : self.i])
            out.append((e, self.name() if self.word("AS") else text))
            if not self.take(","):
                return out

    def tail(self) -> dict:
        out: dict[str, Any] = {"distinct": self.word("DISTINCT"), "items": self.items(), "order": [], "skip": None, "limit": None}
        if self.word("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                out["order"].append((e, down))
                if not self.take(","):
                    break
        out["skip"] = self.expr() if self.word("SKIP") else None
        out["limit"] = self.expr() if self.word("LIMIT") else None
        return out

    def query(self) -> list[tuple]:
        out: list[tuple] = []
        while self.t[self.i][0] != "end":
            if self.word("MATCH"):
                out.append(("match", False, self.patterns(), self.expr() if self.word("WHERE") else None))
            elif self.word("OPTIONAL", "MATCH"):
                out.append(("match", True, self.patterns(), self.expr() if self.word("WHERE") else None))
            elif self.word("WITH"):
                tail = self.tail()
                out.append(("with", tail, self.expr() if self.word("WHERE") else None))
            elif self.word("RETURN"):
                out.append(("return", self.tail()))
            elif self.word("CALL"):
                name = self.name()
                while self.take("."):
                    name += "." + self.name()
                args = {}
                self.need("(")
                if self.take("{"):
                    args = self.map_rest()
                self.need(")")
                wanted = []
                if self.word("YIELD"):
                    wanted.append(self.name())
                    while self.take(","):
                        wanted.append(self.name())
                out.append(("call", name, args, wanted))
            else:
                raise CypherError(f"not supported here: {self.peek()!r} (queries are read-only)")
        return out


def _walk(e):
    if isinstance(e, tuple | list):
        if isinstance(e, tuple):
            yield e
        for x in e:
            yield from _walk(x)
    elif isinstance(e, dict):
        for x in e.values():
            yield from _walk(x)


def _uses(e) -> set[str]:
    return {x[1] for x in _walk(e) if x and x[0] == "var"}


def _aggregated(e) -> bool:
    return any(x[0] == "call" and len(x) == 4 and x[1] in _AGGREGATES for x in _walk(e) if x)


class _Compiler:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any], clauses: list[tuple]):
        self.g, self.params, self.clauses = graph, params, clauses
        self.df: DataFrame | None = None
        self.kinds: dict[str, str] = {}  # variable -> node, edge, path, value
        self.fresh = itertools.count()

    # values

    def value(self, e) -> Any:
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            if e[1] not in self.params:
                raise CypherError(f"missing parameter ${e[1]}")
            return self.params[e[1]]
        if e[0] == "list":
            return [self.value(x) for x in e[1]]
        if e[0] == "neg":
            return -self.value(e[1])
        raise CypherError("a constant is needed here")

    def column(self, e, df: DataFrame) -> Column:
        op, c = e[0], lambda x: self.column(x, df)
        if op in ("lit", "param", "list"):
            if op == "list" and any(x[0] not in ("lit", "param", "neg") for x in e[1]):
                return F.array(*(c(x) for x in e[1]))
            v = self.value(e)
            return F.array(*(F.lit(x) for x in v)) if isinstance(v, list | tuple) else F.lit(v)
        if op == "var":
            if e[1] not in self.kinds:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`") if self.kinds[e[1]] in ("value", "path") else F.col(f"`{e[1]}__id`")
        if op == "prop":
            if e[1][0] == "var" and self.kinds.get(e[1][1]) in ("node", "edge"):
                name = f"{e[1][1]}__{e[2]}"
                return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")  # a property that no row has
            return c(e[1])[e[2]]
        if op == "index":
            return F.get(c(e[1]), c(e[2]))
        if op in ("and", "or"):
            return c(e[1]) & c(e[2]) if op == "and" else c(e[1]) | c(e[2])
        if op == "not":
            return ~c(e[1])
        if op == "neg":
            return -c(e[1])
        if op == "null":
            return c(e[1]).isNull()
        if op == "notnull":
            return c(e[1]).isNotNull()
        if op == "in":
            return c(e[1]).isin(self.value(e[2])) if e[2][0] in ("param", "list") and all(x[0] in ("lit", "param", "neg") for x in (e[2][1] if e[2][0] == "list" else [])) else F.array_contains(c(e[2]), c(e[1]))
        if op == "=~":
            return G.full_match(c(e[1]), self.value(e[2]))
        if op in ("starts", "ends", "contains"):
            return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op](c(e[1]), c(e[2]))
        if op in ("=", "<>", "<", ">", "<=", ">=", "+", "-", "*", "/", "%"):
            a, b = c(e[1]), c(e[2])
            return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op]
        if op == "call":
            return self.function(e, df)
        raise CypherError(f"{op} is not supported here")

    def function(self, e, df: DataFrame) -> Column:
        _, name, distinct, args = e
        if args and args[0] == ("star",):
            return F.count("*")
        if name in ("labels", "type", "id") and args[0][0] == "var":
            v = args[0][1]
            return F.array(F.col(f"`{v}__label`")) if name == "labels" else F.col(f"`{v}__type`") if name == "type" else F.col(f"`{v}__id`")
        if name in ("nodes", "length") and args[0][0] == "var" and self.kinds.get(args[0][1]) == "path":
            p = F.col(f"`{args[0][1]}`")
            return p if name == "nodes" else F.size(p) - 1
        xs = [self.column(a, df) for a in args]
        x = xs[0] if xs else None
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if name in _AGGREGATES:
            if name == "collect":
                return F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
            return (F.sum_distinct(x) if distinct and name == "sum" else getattr(F, name)(x))
        simple = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "reverse": F.reverse, "abs": F.abs, "keys": F.map_keys, "head": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.element_at(c, -1), "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "tofloat": lambda c: c.cast("double")}
        if name in simple:
            return simple[name](x)
        if name == "size":
            kind = df.select(x.alias("x")).schema["x"].dataType.typeName()
            return F.length(x) if kind == "string" else F.size(x)
        if name == "coalesce":
            return F.coalesce(*xs)
        if name == "split":
            return F.split(x, re.escape(self.value(args[1])))
        if name == "substring":
            return F.substr(x, xs[1] + 1, *(xs[2:3]))
        if name == "exists":
            return x.isNotNull()
        raise CypherError(f"no function {name}")

    # patterns

    def node_table(self, n: dict) -> DataFrame:
        t = self.g.nodes(n["label"])
        for k, v in n["props"].items():
            t = t.where(F.col(k) == F.lit(self.value(v)))
        return t.select(*(F.col(c).alias(f"{n['var']}__{c}") for c in t.columns))

    def edge_table(self, e: dict, left: dict, right: dict, backwards: bool) -> DataFrame:
        """near, far, near_label, far_label and the properties."""
        forward = (e["dir"] == "out") != backwards
        parts = []
        for out in [True, False] if e["dir"] == "both" else [forward]:
            src, dst = (left["label"], right["label"]) if out else (right["label"], left["label"])
            if not self.g.keys(e["types"], src, dst):
                continue
            t = self.g.edges(e["types"], src, dst)
            for k, v in e["props"].items():
                t = t.where(F.col(k) == F.lit(self.value(v)))
            ends = ("src", "dst") if out else ("dst", "src")
            names = [c for c in t.columns if c not in ("src", "dst", "type", "src_label", "dst_label")]
            labels = ("src_label", "dst_label") if out else ("dst_label", "src_label")
            one = t.select(F.col(ends[0]).alias("near"), F.col(ends[1]).alias("far"), F.col(labels[0]).alias("near_label"), F.col(labels[1]).alias("far_label"), F.col("type"), F.col("src"), F.col("dst"), *names)
            parts.append(one.where("src <> dst OR src_label <> dst_label") if not out and e["dir"] == "both" else one)
        if not parts:
            raise CypherError(f"no edges {'|'.join(e['types'])} between {left['label']} and {right['label']}")
        return G.union_all(parts)

    def match(self, patterns: list[dict], needed: set[str], distinct_only: bool, df: DataFrame | None, where=None) -> DataFrame:
        used: list[str] = []
        needed = needed | {v for p in patterns for n in p["nodes"] if n["props"] for v in [n["var"]]}
        for p in patterns:
            bound = lambda n: df is not None and n["var"] in self.kinds  # noqa: E731, B023
            nodes, edges = p["nodes"], p["edges"]
            cost = lambda n: 0 if bound(n) else 1 if n["props"] else 2 if n["label"] else 3  # noqa: E731, B023
            backwards = cost(nodes[-1]) < cost(nodes[0])
            if backwards:
                nodes, edges = nodes[::-1], edges[::-1]
            first = nodes[0]
            open_first = not bound(first) and first["anonymous"] and not first["props"] and first["label"] and edges and edges[0]["hops"] is None
            if not open_first:
                df = self.bind(df, first)
            path = [first]
            for e, near, far in zip(edges, nodes, nodes[1:], strict=False):
                if e["hops"] is not None:
                    df = self.varlen(df, e, near, far, backwards, distinct_only and not p["name"], p["name"])
                    path.append(far)
                    continue
                t = self.edge_table(e, near, far, backwards)
                ends = {"near", "far", "near_label", "far_label"}
                t = t.select(*(F.col(c).alias(f"_{c}" if c in ends else f"{e['var']}__{c}") for c in t.columns))
                if df is None or (open_first and near is first and near["var"] not in self.kinds):
                    df = t if df is None else df.crossJoin(t)
                    df = df.withColumn(f"{near['var']}__id", F.col("_near")).withColumn(f"{near['var']}__label", F.col("_near_label"))
                    self.kinds[near["var"]] = "node"
                else:
                    on = df[f"{near['var']}__id"] == t["_near"]
                    if not near["label"]:
                        on = on & (df[f"{near['var']}__label"] == t["_near_label"])
                    df = df.join(t, on)
                self.kinds[e["var"]] = "edge"
                if bound(far):
                    df = df.where((F.col(f"`{far['var']}__id`") == F.col("_far")) & (F.col(f"`{far['var']}__label`") == F.col("_far_label")))
                elif far["var"] in needed:
                    right = self.node_table(far)
                    on = df["_far"] == right[f"{far['var']}__id"]
                    if not far["label"]:
                        on = on & (df["_far_label"] == right[f"{far['var']}__label"])
                    df = df.join(right, on)
                else:
                    df = df.withColumn(f"{far['var']}__id", F.col("_far")).withColumn(f"{far['var']}__label", F.col("_far_label"))
                self.kinds[far["var"]] = "node"
                df = df.drop("_near", "_far", "_near_label", "_far_label")
                for other in used:  # each relationship once
                    same = [F.col(f"`{e['var']}__{c}`").eqNullSafe(F.col(f"`{other}__{c}`")) for c in ("type", "src", "dst")]
                    df = df.where(~(same[0] & same[1] & same[2]))
                used.append(e["var"])
                path.append(far)
            if p["name"] and p["name"] not in self.kinds:
                steps = path[::-1] if backwards else path
                df = df.withColumn(p["name"], F.array(*(F.struct(F.col(f"`{n['var']}__id`").alias("id"), F.array(F.col(f"`{n['var']}__label`")).alias("labels")) for n in steps)))
                self.kinds[p["name"]] = "path"
        return df if where is None else self.where(df, where)

    def bind(self, df: DataFrame | None, n: dict) -> DataFrame:
        if df is not None and n["var"] in self.kinds:
            for k, v in n["props"].items():
                df = df.where(F.col(f"`{n['var']}__{k}`") == F.lit(self.value(v)))
            return df if not n["label"] else df.where(F.col(f"`{n['var']}__label`") == n["label"])
        t = self.node_table(n)
        self.kinds[n["var"]] = "node"
        return t if df is None else df.crossJoin(t)

    def varlen(self, df: DataFrame, e: dict, near: dict, far: dict, backwards: bool, distinct_only: bool, path: str | None) -> DataFrame:
        low, high = e["hops"]
        through = {"label": None}
        t = self.edge_table(e, through, through, backwards).select(F.col("near").alias("_a"), F.col("near_label").alias("_al"), F.col("far").alias("_b"), F.col("far_label").alias("_bl"), F.struct("type", "src", "dst").alias("_e"))
        id_, label = f"{near['var']}__id", f"{near['var']}__label"
        now = df.select(F.col(f"`{id_}`").alias("_s"), F.col(f"`{label}`").alias("_sl")).distinct().withColumns({"_x": F.col("_s"), "_xl": F.col("_sl")})
        frontier = distinct_only and low <= 1 and e["dir"] != "both"
        step = F.struct(F.col("_x").alias("id"), F.array("_xl").alias("labels"))
        if frontier:
            met = None
            found = [now] if low == 0 else []
            for hop in range(1, high + 1):
                new = now.join(t, (F.col("_x") == F.col("_a")) & (F.col("_xl") == F.col("_al"))).select("_s", "_sl", F.col("_b").alias("_x"), F.col("_bl").alias("_xl")).distinct()
                if met is not None:
                    new = new.join(met, ["_s", "_sl", "_x", "_xl"], "left_anti")
                if hop > 1 and hop < high:  # else each hop's plan would hold those of all before it several times
                    new = settled(new)
                    if new.isEmpty():
                        break
                met = new if met is None else met.unionByName(new)
                now = new
            pairs = G.union_all([*found, met] if met is not None else found).distinct()
        else:
            now = now.withColumn("_p", F.array(step)).withColumn("_u", F.array().cast(f"array<{t.schema['_e'].dataType.simpleString()}>"))
            found = [now] if low == 0 else []
            for hop in range(1, high + 1):
                now = now.join(t, (F.col("_x") == F.col("_a")) & (F.col("_xl") == F.col("_al"))).where(~F.array_contains("_u", F.col("_e")))
                now = now.select("_s", "_sl", F.col("_b").alias("_x"), F.col("_bl").alias("_xl"), "_p", F.array_append("_u", F.col("_e")).alias("_u")).withColumn("_p", F.array_append("_p", step))
                if hop >= low:
                    found.append(now)
            pairs = G.union_all(found).drop("_u")
        out = df.join(pairs, (F.col(f"`{id_}`") == F.col("_s")) & (F.col(f"`{label}`") == F.col("_sl"))).drop("_s", "_sl")
        if path:
            out = out.withColumn(path, F.reverse("_p") if backwards else F.col("_p"))
            self.kinds[path] = "path"
        if far["var"] in self.kinds:
            out = out.where((F.col(f"`{far['var']}__id`") == F.col("_x")) & (F.col(f"`{far['var']}__label`") == F.col("_xl")))
        else:
            right = self.node_table(far)
            out = out.join(right, (F.col("_x") == right[f"{far['var']}__id"]) & (F.col("_xl") == right[f"{far['var']}__label"]))
            self.kinds[far["var"]] = "node"
        return out.drop("_x", "_xl", "_p")

    def where(self, df: DataFrame, e) -> DataFrame:
        if e[0] == "and":
            return self.where(self.where(df, e[1]), e[2])
        negated = e[0] == "not" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            _, patterns, where = e[1] if negated else e
            outer = {n["var"] for p in patterns for n in p["nodes"] if n["var"] in self.kinds}
            inner = _Compiler(self.g, self.params, [])
            found = inner.match(patterns, _uses(where), where is None, None, where)
            keys = sorted(c for v in outer for c in (f"{v}__id", f"{v}__label") if c in found.columns and c in df.columns)
            return df.join(found.select(*(F.col(f"`{k}`") for k in keys)), keys, "left_anti" if negated else "left_semi")
        return df.where(self.column(e, df))

    # results

    def project(self, df: DataFrame, tail: dict, final: bool) -> DataFrame:
        items = [(e, name if not (e[0] == "var" and name == e[1]) else name) for e, name in tail["items"]]
        whole = [(e, name) for e, name in items if e[0] == "var" and self.kinds.get(e[1]) in ("node", "edge")]
        if any(_aggregated(e) for e, _ in items):
            keys, keep = [], []
            for e, name in items:
                if _aggregated(e):
                    continue
                if (e, name) in whole and not final:
                    keys += [F.col(f"`{c}`").alias(f"{name}__{c.split('__', 1)[1]}") for c in df.columns if c.startswith(f"{e[1]}__")]
                else:
                    keys.append(self.column(e, df).alias(name))
                keep.append(name)
            out = df.groupBy(*keys).agg(*(self.column(e, df).alias(name) for e, name in items if _aggregated(e)))
        else:
            columns = []
            for e, name in items:
                if (e, name) in whole and not final:
                    columns += [F.col(f"`{c}`").alias(f"{name}__{c.split('__', 1)[1]}") for c in df.columns if c.startswith(f"{e[1]}__")]
                else:
                    columns.append(self.column(e, df).alias(name))
            if tail["order"] and not tail["distinct"]:
                extra = [self.column(e, df).alias(f"_o{i}") if not (e[0] == "var" and e[1] in [n for _, n in items]) else F.lit(0).alias(f"_o{i}") for i, (e, _) in enumerate(tail["order"])]
                out = df.select(*columns, *extra)
            else:
                out = df.select(*columns)
                out = out.distinct() if tail["distinct"] else out
        names = [n for _, n in items]
        before = dict(self.kinds)
        self.kinds = {name: (before[e[1]] if (e, name) in whole and not final else "path" if e[0] == "var" and before.get(e[1]) == "path" else "value") for e, name in items}
        if tail["order"]:
            texts = {repr(e): n for e, n in items}
            order = []
            for i, (e, down) in enumerate(tail["order"]):
                c = F.col(f"`{e[1]}`") if e[0] == "var" and e[1] in names else F.col(f"`{texts[repr(e)]}`") if repr(e) in texts else F.col(f"_o{i}") if f"_o{i}" in out.columns else self.column(e, out)
                order.append(c.desc_nulls_last() if down else c.asc_nulls_last())  # nulls come last either way
            out = out.orderBy(*order).drop(*(c for c in out.columns if re.fullmatch(r"_o\d+", c)))
        if tail["skip"] is not None:
            out = out.offset(self.value(tail["skip"]))
        if tail["limit"] is not None:
            out = out.limit(self.value(tail["limit"]))
        return out

    def run(self) -> DataFrame:
        for at, clause in enumerate(self.clauses):
            rest = self.clauses[at + 1 :]
            if clause[0] == "match":
                _, optional, patterns, where = clause
                needed = _uses(where) | {v for c in rest for v in _uses(c)}
                asked = [x for x in _walk(rest) if x and ((x[0] == "prop" and x[1][0] == "var") or x[0] == "call")]
                returned = next((c[1] for c in rest if c[0] in ("return", "with")), None)
                only = bool(returned) and (returned["distinct"] or all(not _aggregated(e) or all(x[2] for x in _walk(e) if x and x[0] == "call" and x[1] in _AGGREGATES) for e, _ in returned["items"]) and any(_aggregated(e) for e, _ in returned["items"]))
                counted = {x[3][0][1] for x in asked if x[0] == "call" and x[1] == "count" and x[3] and x[3][0][0] == "var"}
                properties = {x[1][1] for x in [*asked, *(y for y in _walk(where) if y and y[0] == "prop" and y[1][0] == "var")] if x[0] == "prop"}
                needed = {v for v in needed if v in properties or v not in counted}
                if optional:
                    outer, kinds = self.df, dict(self.kinds)
                    shared = sorted({n["var"] for p in patterns for n in p["nodes"] if n["var"] in self.kinds})
                    inner = _Compiler(self.g, self.params, [])
                    found = inner.match(patterns, needed, False, None, where)
                    keys = [c for v in shared for c in (f"{v}__id", f"{v}__label")]
                    self.df = outer.join(found.select(*(F.col(f"`{c}`") for c in found.columns if c in keys or c.split("__")[0] not in shared)), keys, "left")
                    self.kinds = kinds | {v: k for v, k in inner.kinds.items() if v not in kinds}
                else:
                    self.df = self.match(patterns, needed, only, self.df, where)
            elif clause[0] == "with":
                self.df = self.project(self.df, clause[1], False)
                if clause[2] is not None:
                    self.df = self.where(self.df, clause[2])
            elif clause[0] == "return":
                return self.project(self.df, clause[1], True)
            else:
                _, name, args, wanted = clause
                self.df = procedures.call(self.g, name, {k: self.value(v) for k, v in args.items()})
                if wanted:
                    self.df = self.df.select(*wanted)
                self.kinds = dict.fromkeys(self.df.columns, "value")
        if self.clauses and self.clauses[-1][0] == "call":
            return self.df
        raise CypherError("a query ends with RETURN")


def run(graph: PropertyGraph, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a query. Without LIMIT nothing is cut off."""
    return _Compiler(graph, params or {}, _Parser(text).query()).run()
