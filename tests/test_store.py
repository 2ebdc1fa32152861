import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.functions import kernels as K
from cairn.functions import tokens
from cairn.plans import ingest
from cairn.plans.store import Store, in_grace
from cairn.plans.versions import Conflict, Versions
from cairn.streaming.progress import Progress

SCHEMA = "file string, content binary"


def test_life_of_a_store(spark, tmp_path):
    rng = random.Random(8)
    a, b = rng.randbytes(300_000), rng.randbytes(120_000)
    s = Store(spark, str(tmp_path / "s"))
    assert s.list_files().count() == 0 and s.usage().count() == 0
    s.put_files(spark.createDataFrame([("a", a), ("b", b), ("c", a), ("e", b"")], SCHEMA))
    assert s.put_files(spark.createDataFrame([("a", a)], SCHEMA)).count() == 0
    rows = {r.files: r for r in s.list_files().collect()}
    assert set(rows) == {"a,c", "b", "e"}
    assert rows["a,c"].original_size == 300_000 and rows["a,c"].unique_size >= 300_000 and rows["a,c"].shared_size == 0
    total = sum(r.packed for r in s.table("places").collect())
    assert sum(r.unique_size + r.shared_size for r in rows.values()) == total
    assert {r.kind: r.objects for r in s.usage().collect()}["shard"] == 4 and s.verify().count() == 0
    probe = spark.createDataFrame([(K.chunk_hashes(K.chunks(a)[:1])[0],), (bytes(32),)], "chunk binary")
    assert sorted(r.found for r in s.query_chunks(probe).collect()) == [False, True]

    req = spark.createDataFrame([(1, "a", "bytes=100000-150000"), (2, "b", None), (3, "a", "bytes=900000-"), (4, "e", None)], "request long, file string, header string")
    plan = s.plan_ranges(req).collect()
    assert {p.request for p in plan} == {1, 2}
    one = [p for p in plan if p.request == 1]
    assert min(p.start for p in one) <= 100_000 and sum(p.unpacked for p in one) < 300_000 and max(p.start + p.unpacked for p in one) > 150_000
    assert all(f.byte_start <= f.byte_end for f in s.fetches(s.plan_ranges(req)).collect())

    s.unlink(spark.createDataFrame([("a",), ("b",)], "file string"))
    dry = {r.kind: (r.n, r.bytes) for r in s.sweep(dry_run=True).collect()}
    real = {r.kind: (r.n, r.bytes) for r in s.sweep().collect()}
    assert dry == real and real["shards"][0] == 2
    assert {r.files for r in s.list_files().collect()} == {"c", "e"} and s.verify().count() == 0
    assert {r.kind: r.n for r in s.sweep().collect()} == {"shards": 0, "containers": 0}
    assert bytes(s.read_files(spark.createDataFrame([("c",)], "file string")).first().content) == a


def contents(spark, s, names):
    return {r.file: (r.content and bytes(r.content), r.error) for r in s.read_files(spark.createDataFrame([(n,) for n in names], "file string")).collect()}


def test_an_unlinked_file_can_be_put_again(spark, tmp_path):
    """put, unlink, put, sweep: the file stays; also with a sweep between, and when only one index names it."""
    data = random.Random(1).randbytes(60_000)
    f1, one = spark.createDataFrame([("f1", data)], SCHEMA), spark.createDataFrame([("f1",)], "file string")
    for between in (False, True):
        s = Store(spark, str(tmp_path / f"s{between}"))
        s.put_files(f1)
        s.unlink(one)
        if between:
            s.sweep()
        assert s.put_files(f1).count() == 1 and s.put_files(f1).count() == 0
        s.sweep()
        assert contents(spark, s, ["f1"]) == {"f1": (data, None)} and s.table("shards").count() == s.table("file_index").count() == 1
        assert s.table("terms").count() == s.table("terms").dropDuplicates(["file", "term"]).count()


def test_missing_and_damaged_files_are_errors(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_files(spark.createDataFrame([("a", b"x" * 9000), ("e", b"")], SCHEMA))
    assert contents(spark, s, ["a", "e", "no"]) == {"a": (b"x" * 9000, None), "e": (b"", None), "no": (None, "unknown file")}
    bad = s.table("shards").withColumn("sha", F.when(F.col("file") == "a", F.lit("0" * 64)).otherwise(F.col("sha")))
    s._replace({"shards": lambda _: bad})
    assert contents(spark, s, ["a", "e"]) == {"a": (None, "digest differs"), "e": (b"", None)} and [r.file for r in s.verify().collect()] == ["a"]


@pytest.mark.parametrize("write", ["staged", "containers", "shards", "file_index", "commit"])
def test_a_put_killed_at_any_write_has_done_nothing(spark, tmp_path, monkeypatch, write):
    s = Store(spark, str(tmp_path / "s"))
    data = random.Random(2).randbytes(20_000)
    files = spark.createDataFrame([("a", data)], SCHEMA)
    old, old_commit = Versions.write, Versions.commit

    class Killed(BaseException):
        """Not an Exception: nothing is tidied up."""

    def dies(self, table, df):
        out = old(self, table, df)
        if table == write:
            raise Killed
        return out

    monkeypatch.setattr(Versions, "write", dies)
    if write == "commit":
        monkeypatch.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        s.put_files(files)
    monkeypatch.setattr(Versions, "write", old)
    monkeypatch.setattr(Versions, "commit", old_commit)
    assert s.table("file_index").count() == 0 and s.usage().count() == 0 and contents(spark, s, ["a"]) == {"a": (None, "unknown file")}
    assert s.put_files(files).count() == 1 and contents(spark, s, ["a"]) == {"a": (data, None)}
    assert s.vacuum(older_than=0) and contents(spark, s, ["a"]) == {"a": (data, None)}


def test_readers_and_puts_beside_a_sweep(spark, tmp_path):
    rng = random.Random(3)
    a, b = rng.randbytes(50_000), rng.randbytes(50_000)
    s = Store(spark, str(tmp_path / "s"))
    s.put_files(spark.createDataFrame([("a", a), ("b", b)], SCHEMA))
    s.unlink(spark.createDataFrame([("a",)], "file string"))
    before, number = s.at(), s.versions.current()
    # A put compares its chunks with those of a version; if a sweep takes them before it commits, it must not commit.
    s.sweep()
    with pytest.raises(Conflict):
        ingest.ingest(spark.createDataFrame([("a2", a)], SCHEMA), s.path, number)
    assert before.table("shards").count() == 2 and s.table("shards").count() == 1
    # The store does it over, from the version after the sweep.
    sweeps = iter([True])
    current = s.versions.current

    def stale():
        return number if next(sweeps, False) else current()

    s.versions.current = stale
    assert s.put_files(spark.createDataFrame([("a2", a)], SCHEMA)).count() == 1
    assert contents(spark, Store(spark, s.path), ["a2", "b", "a"]) == {"a2": (a, None), "b": (b, None), "a": (None, "unknown file")}
    # A table whose folder is gone is an error, not an empty table.
    Store(spark, s.path).versions.drop(current()[1]["terms"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        Store(spark, s.path).table("terms").count()


def test_sweeps_keep_young_objects_and_go_in_steps(spark, tmp_path):
    rng = random.Random(4)
    s = Store(spark, str(tmp_path / "s"))
    names = [f"f{i}" for i in range(5)]
    s.put_files(spark.createDataFrame([(n, rng.randbytes(9000)) for n in names], SCHEMA))
    s.unlink(spark.createDataFrame([(n,) for n in names[:4]], "file string"))
    assert {r.kind: r.n for r in s.sweep(grace=0).collect()} == {"shards": 0, "containers": 0}
    steps = [{r.kind: r.n for r in s.sweep(max_deletes=3).collect()} for _ in range(6)]
    dead = {r.kind: r.n for r in s.sweep(dry_run=True).collect()}
    assert steps[0] == {"shards": 3, "containers": 0} and steps[1]["shards"] == 1 and all(sum(x.values()) <= 3 for x in steps) and dead == {"shards": 0, "containers": 0}
    assert contents(spark, s, names[4:])["f4"][1] is None and s.table("containers").count() == 1


def test_reads_go_on_from_any_byte(spark, tmp_path):
    rng = random.Random(5)
    data = rng.randbytes(300_000)
    s = Store(spark, str(tmp_path / "s"))
    s.put_files(spark.createDataFrame([("a", data), ("e", b"")], SCHEMA))
    spans = [(None, None), (0, 0), (299_999, None), (123_456, 200_000), (250_000, 10**9), (300_000, None)]
    req = spark.createDataFrame([(i, "a", lo, hi) for i, (lo, hi) in enumerate(spans)] + [(9, "e", 0, None), (10, "no", 0, 5)], "request long, file string, lo long, hi long")
    got = {}
    for r in sorted(s.read_parts(req).collect(), key=lambda r: (r.request, r.at)):
        assert r.at == (spans[r.request][0] or 0) + len(got.get(r.request, b""))
        got[r.request] = got.get(r.request, b"") + bytes(r.part)
    want = {i: data[lo or 0 : hi + 1 if hi is not None else None] for i, (lo, hi) in enumerate(spans)}
    assert got == {i: v for i, v in want.items() if v}


def test_grace(spark):
    now = F.lit("2024-01-01 01:00:00.7").cast("timestamp")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    (r,) = spark.range(1).select(in_grace(at, 0, now).alias("a"), in_grace(at, 60, now).alias("b"), in_grace(at, -1, now).alias("c")).collect()
    assert (r.a, r.b, r.c) == (True, False, False)


def test_tokens(spark):
    key = b"secret"
    made = [tokens.sign(key, "read", 100, file="f"), tokens.sign(key, "write", 100), tokens.sign(b"other", "write", 100), tokens.sign(key, "write", 5), "junk", None]
    df = spark.createDataFrame([(t,) for t in made], "t string").withColumn("g", tokens.grant(key, F.col("t"), 50))
    x = df.select(*[tokens.allows(F.col("g"), F.lit(p), F.lit(f), F.lit(None).cast("string")) for p, f in (("read", "f"), ("read", "x"), ("write", "f"))])
    assert [tuple(r) for r in x.collect()] == [(True, False, False), (True, True, True), *[(False,) * 3] * 4]


def test_progress_repeats_the_last_frame():
    seen = []
    p = Progress(seen.append, every=0.05)
    p._frame(type="committing", batch=1)
    time.sleep(0.3)
    p.stop.set()
    assert len(seen) >= 3 and all(f == {"type": "committing", "batch": 1} for f in seen)
