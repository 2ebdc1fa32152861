"""The kernels as Arrow UDFs and table functions, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K


@F.pandas_udf(T.BinaryType())
def chunk_hash(data: pd.Series) -> pd.Series:
    return pd.Series(K.chunk_hashes(data.tolist()))


@F.pandas_udf(T.BinaryType())
def keyed_hash(h: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([K.hmac(a, b) for a, b in zip(h, key, strict=True)])


@F.pandas_udf(T.BinaryType())
def term_hash(hashes: pd.Series) -> pd.Series:
    return pd.Series([K.term_hash(list(x)) for x in hashes])


@F.pandas_udf(T.BinaryType())
def group_bytes(data: pd.Series) -> pd.Series:
    return data.map(K.group_bytes)


@F.pandas_udf(T.BinaryType())
def ungroup_bytes(data: pd.Series) -> pd.Series:
    return data.map(K.ungroup_bytes)


@F.pandas_udf(T.DoubleType())
def divergence(data: pd.Series) -> pd.Series:
    return data.map(K.divergence)


@F.pandas_udf(T.IntegerType())
def choose_scheme(data: pd.Series) -> pd.Series:
    return data.map(K.choose_scheme)


@F.pandas_udf(T.BinaryType())
def merkle_root(nodes: pd.Series) -> pd.Series:
    """nodes: arrays of struct<hash: binary, size: long> in order."""
    return pd.Series([K.merkle_root([(x["hash"], x["size"]) for x in n]) for n in nodes])


@F.pandas_udf(T.BinaryType())
def file_hash(nodes: pd.Series) -> pd.Series:
    return pd.Series([K.file_hash([(x["hash"], x["size"]) for x in n]) for n in nodes])


@F.pandas_udf(T.BinaryType())
def joined(parts: pd.Series) -> pd.Series:
    """The bytes of an array's values, one after the other."""
    return pd.Series([b"".join(x) for x in parts])


class Chunks:
    """Table function: offset, size and hash of the content-defined chunks of a value."""

    def eval(self, content: bytes):
        at = 0
        parts = K.chunks(content or b"")
        for part, h in zip(parts, K.chunk_hashes(parts), strict=True):
            yield at, len(part), h
            at += len(part)


def register(spark: SparkSession) -> None:
    """cairn_* functions for SQL."""
    for f in (chunk_hash, keyed_hash, term_hash, group_bytes, ungroup_bytes, divergence, choose_scheme, merkle_root, file_hash):
        spark.udf.register(f"cairn_{f.__name__}", f)
    spark.udtf.register("cairn_chunks", F.udtf(Chunks, returnType="off long, size long, chunk binary"))


def chunk_files(files: DataFrame, content: bool = True) -> DataFrame:
    """file, seq, off, size, chunk (hash) and the chunk's bytes, for files (file, content)."""
    table = files.sparkSession.conf.get(K.GEAR_CONF, None)
    kind = dict(files.dtypes)["file"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gear = K.gear_table(table)
        for b in batches:
            out = []
            for name, data in b.itertuples(index=False, name=None):
                at = 0
                for seq, c in enumerate(K.chunks(data, gear)):
                    out.append((name, seq, at, len(c), c))
                    at += len(c)
            if out:
                pdf = pd.DataFrame(out, columns=["file", "seq", "off", "size", "content"])
                pdf["chunk"] = K.chunk_hashes(pdf["content"].tolist())
                yield pdf if content else pdf.drop(columns="content")

    schema = f"file {kind}, seq long, off long, size long, {'content binary, ' if content else ''}chunk binary"
    return files.select("file", "content").mapInPandas(run, schema)


def file_hashes(chunks: DataFrame) -> DataFrame:
    """file, file_hash, n, size of chunked files (file, seq, chunk, size)."""
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk", "size"))), lambda x: F.struct(x["chunk"].alias("hash"), x["size"].alias("size")))
    x = chunks.groupBy("file").agg(nodes.alias("nodes"), F.count("*").alias("n"), F.sum("size").alias("size"))
    return x.select("file", file_hash("nodes").alias("file_hash"), "n", "size")
