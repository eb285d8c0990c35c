"""Python's view of Rust: metadata of attributes as typed columns, and edges between the two languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metadata that become columns. A flag that isn't told is false, a text that isn't told is null.
FUNCTION_FLAGS, FUNCTION_TEXTS = ("is_pymethod", "is_pymodule", "is_ffi"), ("ffi_kind", "py_name")
TYPE_FLAGS, TYPE_TEXTS = ("is_pyclass",), ("py_name",)


def promoted(rows: DataFrame, flags: tuple[str, ...], texts: tuple[str, ...], column: str = "metadata") -> DataFrame:
    """rows with keys of a sparse map as typed columns in its place."""
    value = lambda k: F.try_element_at(column, F.lit(k))
    told = {k: F.coalesce(value(k).cast("boolean"), F.lit(False)) for k in flags} | {k: value(k) for k in texts}
    return rows.withColumns(told).drop(column)


def _short(c: str):
    return F.element_at(F.split(c, r"::|\."), -1)


def binds(functions: DataFrame) -> DataFrame:
    """BINDS (src, dst): methods of Python classes and the Rust methods behind them, by class and name, where one Rust method has both."""
    rust = functions.where("is_pymethod AND owner IS NOT NULL").select(_short("owner").alias("owner"), F.col("title").alias("method"), F.col("id").alias("dst"))
    one = rust.groupBy("owner", "method").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    python = functions.where("language = 'python' AND is_method AND size(split(id, '[.]')) >= 3").select(F.col("id").alias("src"), _short("owner").alias("owner"), F.col("title").alias("method"))
    return python.join(one, ["owner", "method"]).select("src", "dst").distinct()


def exposes(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """EXPOSES (src, dst, label, py_name): the functions that make a Python module, and the classes and functions of their crate that Python sees.

    A crate is what stands before the last `src` folder of a path: joined by it, crates of one tree don't meet each other's modules."""
    crate = F.regexp_extract("file_path", r"^(.*/|)src/", 1)
    modules = functions.where("is_pymodule").select(crate.alias("crate"), F.col("id").alias("src"))
    name = F.coalesce("py_name", "title").alias("py_name")
    types = classes.where("is_pyclass").select(crate.alias("crate"), F.col("id").alias("dst"), F.col("_label").alias("label"), name)
    free = functions.where("ffi_kind = 'pyo3' AND NOT is_pymodule AND NOT is_method").select(crate.alias("crate"), F.col("id").alias("dst"), F.lit("Function").alias("label"), name)
    return modules.join(types.unionByName(free), "crate").drop("crate").distinct()
