"""Web routes that source code registers: by decorators (Flask, FastAPI) and by lists of paths (Django)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.sources import arguments as A

#: Verbs that decorators of the frameworks have, holders that only FastAPI has, calls in a list of Django's paths.
FLASK_VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
FASTAPI_VERBS = (*FLASK_VERBS, "trace")
FASTAPI_HOLDERS = ("router", "api_router")
DJANGO_CALLS = ("path", "re_path", "url")


def decorated(raw: str, fastapi: bool) -> list[tuple[str, str, str]]:
    """(framework, method, path) that a decorator registers; fastapi: whether its file imports FastAPI, which settles what `@app.get` is."""
    if not (parts := A.call(raw)):
        return []
    head, arguments = parts
    words = [""] + head.split(".")
    verb, holder, path = words[-1].lower(), words[-2].lower(), A.first_string(arguments)
    if path is None:
        return []
    own = holder in FASTAPI_HOLDERS
    if verb == "route" and not own:
        listed = A.keyword(arguments, "methods")
        return [("flask", m, path) for m in (["ANY"] if listed is None else A.names(listed))]
    if verb in FASTAPI_VERBS and (own or holder == "app" and fastapi):
        return [("fastapi", verb.upper(), path)]
    return [("flask", verb.upper(), path)] if verb in FLASK_VERBS and not own and not fastapi else []


def listed(preview: str) -> list[tuple[str, str | None]]:
    """(path, bare name of the view) of each entry of a list of Django's paths; no name for what another list is included by."""
    out = []
    for arguments in A.calls_of(preview, DJANGO_CALLS):
        path, parts = A.first_string(arguments), A.split(arguments)
        if path is not None:
            view = parts[1] if len(parts) > 1 and not parts[1].startswith("include(") else None
            out.append((path, view and view.split("(")[0].removesuffix(".as_view").rsplit(".", 1)[-1]))
    return out


def _mapped(rows: DataFrame, work, names: str) -> DataFrame:
    """rows (id, file_path, text, flag) -> id, file_path and strings from work(text, flag)."""
    import pyarrow as pa

    columns = ["id", "file_path", *names.split()]

    def run(batches):
        for batch in batches:
            out = [(i, f, *x) for i, f, t, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in work(t, flag)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [()] * len(columns))], columns)

    return rows.select("id", "file_path", "text", "flag").mapInArrow(run, ", ".join(f"{c} string" for c in columns))


def routes(functions: DataFrame, facts: DataFrame, constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """functions (id, title, file_path, decorators, nesting_depth), facts (path, imports), constants (title, file_path, value_preview) -> Route nodes and HANDLES edges.

    A route's id is FRAMEWORK::METHOD::PATH::FILE: one registration is one route, and no two frameworks claim it. A listed path is handled by the one function of
    the view's name, functions within functions only in their own file."""
    evidence = facts.select(F.col("path").alias("file_path"), F.explode("imports").alias("i")).where(F.split("i.name", r"\.")[0] == "fastapi").select("file_path").distinct().withColumn("flag", F.lit(True))
    calls = functions.select("id", "file_path", F.explode("decorators").alias("text")).where(F.contains("text", F.lit("(")))
    marked = calls.join(evidence, "file_path", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    found = _mapped(marked, decorated, "framework method path")
    lists = constants.where("title = 'urlpatterns' AND value_preview IS NOT NULL").select("id", "file_path", F.col("value_preview").alias("text"), F.lit(False).alias("flag"))
    django = _mapped(lists, lambda t, _: [("django", "ANY", p, v) for p, v in listed(t)], "framework method path view")
    whole = functions.select(F.col("title").alias("view"), F.col("id").alias("dst"), F.when(F.col("nesting_depth") > 0, F.col("file_path")).alias("only"))
    asked = django.select("view", "file_path").where("view IS NOT NULL").distinct()
    seen = asked.join(whole, "view").where("only IS NULL OR only = file_path")
    handler = R.unique_match(asked.withColumn("at", F.struct("view", "file_path")), seen.select(F.struct("view", "file_path").alias("at"), "dst"), "at", "dst").select("view", "file_path", "dst")
    every = found.withColumn("dst", F.col("id")).drop("id").unionByName(django.join(handler, ["view", "file_path"], "left").drop("id", "view"))
    every = every.withColumn("route", F.concat_ws("::", "framework", "method", "path", "file_path"))
    nodes = every.select(F.col("route").alias("id"), F.col("path").alias("title"), "framework", "method", "file_path").distinct()
    return nodes, every.where("dst IS NOT NULL").select(F.col("route").alias("src"), "dst").distinct()
