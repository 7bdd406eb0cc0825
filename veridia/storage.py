"""Tables between jobs: written to the folder that all executors share, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one of our own only
    where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="veridia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders that materialise wrote and nothing deleted yet, in order.
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        _written[:] = [w for w in _written if not folder.endswith(w.split(":", 1)[-1])]


def written() -> set[str]:
    """Folders of all materialised tables that are still there."""
    return set(_written)


def discard(spark: SparkSession, before: set[str], keep: DataFrame) -> None:
    """Delete what was materialised since `before`, but for the table `keep`."""
    own = {f.rsplit("/", 1)[0] for f in keep.inputFiles()}
    for folder in [w for w in _written if w not in before and not any(f.endswith(w.split(":", 1)[-1]) for f in own)]:
        _delete(spark, folder)
        _written.remove(folder)
