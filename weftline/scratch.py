"""Working tables that cut lineage, kept where every executor can read them.

Loops in this package write each round's state as a Parquet table and read it
back, so a lost executor costs one round and never a whole lineage. The place
is ``spark.checkpoint.dir`` of the session. Only a local session may go without
that setting; then, and only then, a temporary folder of this machine is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _local_roots[app]


class Scratch:
    """A folder of working tables belonging to one call of one operator."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/weftline/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, **counts) -> tuple[DataFrame, dict]:
        """Write ``df``; return the table read back and the observed aggregates.

        ``counts`` are aggregate columns evaluated while the rows are written,
        so no loop needs a second pass just to learn whether it is done.
        """
        self._n += 1
        path = self.path(f"t{self._n:04d}")
        seen: dict = {}
        out = df
        if counts:
            watch = Observation()
            out = df.observe(watch, *(c.alias(k) for k, c in counts.items()))
        out.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if counts:
            seen = watch.get
        back = self.spark.read.schema(df.schema).parquet(path)
        back._weftline_path = path
        return back, seen

    def clear(self) -> None:
        """Remove everything written so far."""
        delete(self.spark, self.root)

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove working tables that no later step reads."""
        for t in tables:
            path = getattr(t, "_weftline_path", None)
            if path:
                delete(self.spark, path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rows(df: DataFrame):
    """The aggregate to pass to :meth:`Scratch.write` for a row count."""
    return F.count(F.lit(1))


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()
