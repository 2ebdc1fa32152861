import random

from pyspark.sql import functions as F

from cairn.functions import kernels as K
from cairn.functions import udfs
from cairn.plans import ingest
from cairn.sources import codec, readers


def test_ingest_dedup_and_rebuild(spark, tmp_path):
    rng = random.Random(1)
    a = rng.randbytes(400_000)
    b = a[:250_000] + b"changed" + a[250_000:] + b"text " * 9000
    store = str(tmp_path / "store")
    schema = "file long, content binary"
    first = ingest.ingest(spark.createDataFrame([(1, a), (2, b""), (3, b"small")], schema), store)
    ingest.ingest(spark.createDataFrame([(4, b), (5, a)], schema), store)
    places = spark.read.parquet(store + "/places")
    want = set(K.chunk_hashes(K.chunks(a) + K.chunks(b) + [b"small"]))
    assert places.count() == places.select("chunk").distinct().count() == len(want)
    out = {r.file: bytes(r.content) for r in ingest.rebuild(spark, store, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "file long")).collect()}
    assert out == {1: a, 2: b"", 3: b"small", 4: b, 5: a}
    files = spark.read.parquet(store + "/shards")
    names = {r.file: bytes(r.file_hash) for r in files.collect()}
    assert names[1] == names[5] == K.file_hash([(h, len(c)) for h, c in zip(K.chunk_hashes(K.chunks(a)), K.chunks(a), strict=True)]) and names[2] == K.ZERO
    shards = ingest.shard_objects(files, spark.read.parquet(store + "/terms")).collect()
    for r in shards:
        s = codec.decode_shard(bytes(r.content), "required")
        assert s.files[0].file == names[r.file] and codec.validate_shard(s) == []
    for r in ingest.container_shards(places).collect():
        s = codec.decode_shard(bytes(r.content))
        assert codec.validate_shard(s) == [] and s.containers[0].container == bytes(r.container)
    raw = spark.read.parquet(store + "/containers")
    assert all(codec.validate_container(bytes(r.content), bytes(r.container)) == [] for r in raw.collect())
    rows = readers.container_rows(raw.select(F.hex("container").alias("name"), "content"))
    assert rows.count() == len(want)


def test_sql_functions(spark):
    udfs.register(spark)
    data = random.Random(2).randbytes(50_000)
    df = spark.createDataFrame([(data,)], "d binary")
    df.createOrReplaceTempView("t")
    rows = spark.sql("select c.* from t, lateral cairn_chunks(d) c order by off").collect()
    assert [r.size for r in rows] == [len(c) for c in K.chunks(data)]
    (r,) = spark.sql("select cairn_chunk_hash(d) h, cairn_ungroup_bytes(cairn_group_bytes(d)) back, cairn_choose_scheme(d) s from t").collect()
    assert bytes(r.h) == K.chunk_hashes([data])[0] and bytes(r.back) == data and r.s == K.LZ4
