import random

from cairn.streaming import flows


def events(n=200, keys=5):
    rng = random.Random(7)
    kinds = ["request", "request", "request", "done", "failed", "probe"]
    return [(f"k{rng.randrange(keys)}", i, rng.choice(kinds), i * 7, rng.choice(["a", "b", None])) for i in range(n)]


SCHEMA = "key string, ord long, kind string, at long, etag string"


def test_transitions():
    s = flows.START
    s, a = flows.transition(s, "request", 0, None, 300)
    assert a == "start"
    assert flows.transition(s, "request", 1, None, 300)[1] == "wait"
    f, a = flows.transition(s, "failed", 5, None, 300)
    assert a == "failed" and f[3:] == (1, 15) and flows.transition(f, "request", 14, None, 300)[1] == "backoff" and flows.transition(f, "request", 15, None, 300)[1] == "start"
    r, _ = flows.transition(s, "done", 10, "e", 300)
    assert [flows.transition(r, "request", 400, None, v)[1] for v in (300, 0, -1, 1000)] == ["revalidate", "revalidate", "ready", "ready"]
    assert flows.transition(r, "probe", 20, "x", 300)[1] == "dropped" and flows.transition(r, "probe", 20, None, 300)[1] == "kept" and flows.transition(r, "probe", 20, "e", 300)[1] == "valid"


def test_stream_equals_replay(spark, tmp_path):
    ev = events()
    for i in range(0, len(ev), 50):
        spark.createDataFrame(ev[i : i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.resolve(src).writeStream.format("memory").queryName("resolved").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.ord, r.at, r.answer, r.failures) for r in spark.table("resolved").collect())
    want = []
    for k in {e[0] for e in ev}:
        want += [(k, *x) for x in flows.replay([e[1:] for e in ev if e[0] == k])]
    assert got == sorted(want)


def test_quiet_and_put_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    touches = [(1, t0), (1, t0 + timedelta(seconds=1)), (1, t0 + timedelta(seconds=9)), (2, t0), (3, t0 + timedelta(seconds=100))]
    spark.createDataFrame(touches, "container long, ts timestamp").write.parquet(str(tmp_path / "t"))
    src = spark.readStream.schema("container long, ts timestamp").parquet(str(tmp_path / "t"))
    q = flows.quiet(src).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.container, r.n) for r in spark.table("quiet").collect()) == [(1, 1), (1, 2), (2, 1)]
    w = [("a", "1", 0), ("a", "2", 1), ("b", "3", 2)]
    schema = "key string, value string, ord long"
    for part in (w, [("a", "9", 0), ("c", "4", 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "w"))
        flows.put_stream(src, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
