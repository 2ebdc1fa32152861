"""A folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the driver ends. Where that is unset, a local session gets a temporary
    folder (tests); a cluster must name one, since its executors do not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")

        base = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
