"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as the inside of a character class.
WS = r"\x20\x09-\x0D"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]+|[{WS}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def count_words(text: Column) -> Column:
    """Number of words of a text, without building them; null gives 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{WS}]++", "x")
    return F.length(F.regexp_replace(marks, f"[{WS}]++", "")).cast("long")


def free(name: str, taken: list[str]) -> str:
    """name, with as many signs before it as make it none of those taken (in any case of letters)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of
    its own (tests); a cluster must name one, since its executors do not see the driver's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")

        path = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)  # at the latest when the driver ends
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The folders that cut() wrote and that are still there, oldest first."""
    return list(_written)


def drop_cuts(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes what cut() wrote (all, or these of written()); call it once the results that read those tables are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in _written[:] if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(x)
