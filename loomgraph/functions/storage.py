"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir as the session has it. Where it is unset: a temporary
    folder for a session on one machine, and a folder in the warehouse on a cluster, unless that is a machine's own folder, which isn't shared."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if spark.sparkContext.master.split("[")[0] == "local":
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        return _LOCAL["dir"]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a folder of one machine")
    return warehouse + "/.loomgraph-scratch"


def written(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage is cut, and a lost executor costs no earlier step."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more; other DataFrames are passed over."""
    for df in tables:
        if at := getattr(df, "_written_at", None):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: One step of an iteration.
settled = written
