"""Finding chunks that are stored already, and writing what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_bits(hash_hex: Column) -> tuple[Column, Column]:
    """The two low bytes of the last little-endian word of a 32-byte hash given in hex (bytes 24 and 25)."""
    at = lambda i: F.conv(F.substring(hash_hex, i, 2), 16, 10).cast("int")
    return at(49), at(51)


def merkle_cut(hash_hex: Column) -> Column:
    return low_bits(hash_hex)[0].bitwiseAND(3) == 0


def sampled(hash_hex: Column) -> Column:
    """The last word modulo 1024 is 0."""
    a, b = low_bits(hash_hex)
    return (a == 0) & (b.bitwiseAND(3) == 0)


ELIGIBLE_FLAG = 1 << 31


def eligible(hash_hex: Column, first: Column, flags: Column) -> Column:
    """Whether a chunk may be asked for globally: a file's first, flagged, or sampled."""
    return first | (flags.bitwiseAND(ELIGIBLE_FLAG) != 0) | sampled(hash_hex)


def eligible_chunks(container_chunks: DataFrame, file_starts: DataFrame) -> DataFrame:
    """Eligible chunks of each shard, each hash at its first place. container_chunks: shard, cas_ord, container, idx, hash,
    flags; file_starts: shard, container, idx of the files' first chunks."""
    starts = file_starts.select("shard", "container", "idx").distinct().withColumn("__first", F.lit(True))
    x = container_chunks.join(starts, ["shard", "container", "idx"], "left")
    x = x.where(eligible(F.col("hash"), F.coalesce("__first", F.lit(False)), F.col("flags")))
    first = F.min(F.struct("cas_ord", "idx", "container")).alias("__m")
    return x.groupBy("shard", "hash").agg(first).select("shard", "hash", "__m.container", "__m.idx")


def last_locations(container_chunks: DataFrame, by: list[str] = (), key: str = "chunk", order=("container", "idx")) -> DataFrame:
    """One location per chunk: where several hold it, the last."""
    best = F.max(F.struct(*order)).alias("__m")
    return container_chunks.groupBy(*by, key).agg(best).select(*by, key, *[f"__m.{c}" for c in order])


def first_locations(container_chunks: DataFrame, by: list[str] = (), key: str = "chunk", order=("container", "idx")) -> DataFrame:
    """One location per chunk: where several hold it, the first."""
    best = F.min(F.struct(*order)).alias("__m")
    return container_chunks.groupBy(*by, key).agg(best).select(*by, key, *[f"__m.{c}" for c in order])


def resolve(chunks: DataFrame, locations: DataFrame, key: str = "chunk") -> DataFrame:
    """Chunks that have a location."""
    return chunks.join(locations, key)


def keyed_resolve(probes: DataFrame, shard_keys: DataFrame, shard_chunks: DataFrame, keyed) -> DataFrame:
    """Probes against shards that store keyed hashes. probes: shard, chunk; shard_keys: shard, key (null: raw hashes), expiry;
    shard_chunks: shard, stored, container, idx; keyed(chunk, key): the keyed hash."""
    x = probes.join(shard_keys, "shard")
    x = x.withColumn("stored", F.when(F.col("key").isNull(), F.col("chunk")).otherwise(keyed(F.col("chunk"), F.col("key"))))
    return x.join(shard_chunks, ["shard", "stored"]).select("shard", "chunk", "container", "idx")


def unexpired(shards: DataFrame, now: Column) -> DataFrame:
    """Shards whose key is valid: expiry is null (never) or later than now."""
    return shards.where(F.col("expiry").isNull() | (F.col("expiry") > now))


def new_chunks(chunks: DataFrame, known: DataFrame, key: str = "chunk") -> DataFrame:
    return chunks.join(known.select(key), key, "left_anti")


def query_batch(requests: DataFrame, chunk_index: DataFrame, shard_chunks: DataFrame) -> DataFrame:
    """A row per request (ord, chunk): found, container, idx: the first place in the shard that the index names."""
    first = first_locations(shard_chunks, ["shard"])
    hit = chunk_index.join(first, ["shard", "chunk"]).select("chunk", "container", "idx")
    return requests.join(hit, "chunk", "left").select("ord", "chunk", F.col("container").isNotNull().alias("found"), "container", "idx")


def by_precedence(sources: list[DataFrame], key: str = "chunk") -> DataFrame:
    """Locations (key, container, idx) from several sources: the earlier source wins, then the least location."""
    every = None
    for i, s in enumerate(sources):
        s = s.select(key, F.lit(i).alias("source"), "container", "idx")
        every = s if every is None else every.union(s)
    return first_locations(every, key=key, order=("source", "container", "idx"))


def put_if_absent(existing: DataFrame, writes: DataFrame, key: str = "key", order=("ord",)) -> DataFrame:
    """Every write with inserted: the first write of a key that is not there yet. writes: key, value, and the order columns."""
    first = writes.groupBy(key).agg(F.min(F.struct(*order)).alias("__f"))
    there = existing.select(key).distinct().withColumn("__there", F.lit(True))
    x = writes.join(first, key).join(there, key, "left")
    return x.withColumn("inserted", F.col("__there").isNull() & (F.struct(*order) == F.col("__f"))).drop("__f", "__there")


def after_puts(existing: DataFrame, puts: DataFrame) -> DataFrame:
    """The table after put_if_absent."""
    return existing.unionByName(puts.where("inserted").select(*existing.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The table without the keys, and for each key whether it existed."""
    there = table.select(key).distinct().withColumn("__there", F.lit(True))
    return table.join(keys, key, "left_anti"), keys.join(there, key, "left").select(key, F.col("__there").isNotNull().alias("existed"))


def last_wins(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Maps merged: a later table's value replaces an earlier one's."""
    every = None
    for i, t in enumerate(tables):
        t = t.select(key, F.lit(i).alias("__i"), value)
        every = t if every is None else every.union(t)
    return every.groupBy(key).agg(F.max(F.struct("__i", value)).alias("__m")).select(key, f"__m.{value}")
