import random
from datetime import datetime

import pytest

from cairn.functions import kernels as K
from cairn.sources import codec as C
from cairn.sources import readers

RNG = random.Random(4)


def h():
    return RNG.randbytes(32)


def sample():
    c1, c2 = h(), h()
    k1 = [C.Chunk(h(), 0, 10), C.Chunk(h(), 10, 20, 1 << 31)]
    files = [C.FileBlock(h(), [C.Term(c1, 30, 0, 2), C.Term(c2, 7, 3, 4)], [h(), h()], h()), C.FileBlock(h(), [], None, None)]
    return C.Shard(files, [C.ContainerBlock(c1, k1, 30, 44)])


@pytest.mark.parametrize("with_footer", [False, True])
def test_shard_round_trip(with_footer):
    s = sample()
    s.footer = C.new_footer(s, 1700000000) if with_footer else None
    data = C.encode_shard(s, with_footer)
    assert len(data) == C.encoded_size(s, with_footer)
    seen = []
    back = C.decode_shard(data, on_container=seen.append)
    assert back == s and seen == s.containers and C.validate_shard(s) == []
    with pytest.raises(ValueError):
        C.decode_shard(data, "forbidden" if with_footer else "required")
    with pytest.raises(ValueError):
        C.decode_shard(data[:-1])
    with pytest.raises(ValueError):
        C.decode_shard(data, fmt=C.Format(magic=bytes(17)))
    assert C.shard_name(s) == C.shard_name(back) and len(C.shard_name(s)) == 64
    if with_footer:
        assert not back.footer.keyed and not back.footer.expired(1 << 62) and back.footer.materialized == 37


def test_shard_faults():
    s = sample()
    s.containers[0].chunks[1].start = 11
    s.containers.append(s.containers[0])
    s.files[0].terms[0].unpacked = 1
    s.files[1].terms.append(C.Term(h(), 1, 4, 4, 2))
    s.files[0].verification.pop()
    bad = C.validate_shard(s)
    assert {"duplicate container", "chunk offsets are not contiguous", "term bytes", "empty term", "reserved term flags", "verification count"} <= set(bad)


def chunks(n=70):
    kinds = [lambda: RNG.randbytes(9000), lambda: b"text and text " * 700, lambda: b"".join(bytes([i % 256, 0, 7, 1]) for i in range(3000))]
    return [kinds[i % 3]() for i in range(n)]


def test_container_round_trip():
    cs = chunks()
    data, root, ends, hashes = C.encode_container(cs, frozenset({0, 40}), nonce=b"abcd")
    assert C.decode_chunks(data) == cs and hashes == K.chunk_hashes(cs)
    assert C.read_offsets(data) == C.scan_offsets(data) == C.offsets(data) == ends
    bare, root2, _, _ = C.encode_container(cs, frozenset({0, 40}), footer=False)
    assert root2 == root and C.read_offsets(bare) is None and C.offsets(bare) == ends
    assert C.validate_container(data, root) == C.validate_container(bare, root) == []
    lo, hi = C.packed_range(ends, 3, 9)
    assert C.decode_chunks(data[lo : hi + 1]) == cs[3:9] and C.packed_range(ends, 0, 1) == (0, ends[0] - 1)
    with pytest.raises(ValueError):
        C.packed_range(ends, 5, 5)


def test_container_faults():
    cs = chunks(5)
    data, root, ends, _ = C.encode_container(cs)
    assert C.validate_container(data, bytes(32)) == ["hash", "footer"]
    hurt = bytearray(data)
    hurt[ends[-1] + 60] ^= 1
    assert C.validate_container(bytes(hurt), root) == ["footer hashes"]
    assert C.validate_container(data[: ends[0] - 1], root)
    assert C.validate_container(b"\1" + data[1:], root)
    with pytest.raises(ValueError):
        C.encode_container([b"x"] * 8193)


def test_cache_entries():
    cs = chunks(4)
    raw = C.encode_cache(cs)
    assert C.decode_cache(raw, 6, 10) == cs
    for bad in (raw[:-1], raw[:-5] + b"x" + raw[-4:], raw + b"x"):
        with pytest.raises(ValueError):
            C.decode_cache(bad, 6, 10)
    with pytest.raises(ValueError):
        C.decode_cache(raw, 6, 11)


def test_readers(spark, tmp_path):
    s = sample()
    now = datetime(2024, 1, 2)
    rows = [("a", now, C.encode_shard(s)), ("b", now, b"junk")]
    raw = spark.createDataFrame(rows, "path string, modificationTime timestamp, content binary")
    nested = readers.shards(raw).cache()
    assert {r.path: r.readable for r in nested.collect()} == {"a": True, "b": False}
    terms = readers.file_terms(nested.where("readable")).collect()
    assert [(t.file_ord, t.term_ord, t.unpacked) for t in terms] == [(0, 0, 30), (0, 1, 7), (1, None, None)]
    assert bytes(terms[0].verification) == s.files[0].verification[0]
    assert [(c.idx, c.start, c.size) for c in readers.container_chunks(nested).collect()] == [(0, 0, 10), (1, 10, 20)]
    cs = chunks(3)
    data, _, ends, hashes = C.encode_container(cs)
    got = readers.container_rows(spark.createDataFrame([("c", data)], "name string, content binary")).collect()
    assert [bytes(r.content) for r in got] == cs and [r.pend for r in got] == ends and [bytes(r.hash) for r in got] == hashes
    cached = spark.createDataFrame([("0-3_0-99", C.encode_cache(cs)), ("0-4_0-99", C.encode_cache(cs))], "name string, content binary")
    assert {r.name: (r.ok, r.chunks) for r in readers.cached_ranges(cached).collect()} == {"0-3_0-99": (True, 3), "0-4_0-99": (False, 0)}


def test_directories(spark, tmp_path):
    name = "ab" * 32
    (tmp_path / "o" / "ab").mkdir(parents=True)
    (tmp_path / "o" / "ab" / name).write_bytes(b"12345")
    (tmp_path / "o" / "ab" / "other.txt").write_bytes(b"x")
    assert [(r.name, r.size) for r in readers.objects(spark, str(tmp_path / "o")).collect()] == [(name, 5)]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / name).write_text("value\n")
    assert [tuple(r) for r in readers.index_entries(spark, str(tmp_path / "i")).collect()] in ([(name, "value\n")], [(name, "value")])
    (tmp_path / "m.json").write_text('{"repo": "r", "commit": "c", "files": {"a/b": {"file_hash": "h", "size": 3}}}')
    (m,) = readers.manifests(spark, str(tmp_path / "m.json")).collect()
    assert (m.repo, m.path, m.file_hash, m.size) == ("r", "a/b", "h", 3)


def test_json_streams(spark):
    lines = [("a", 0, '{"type": "validating"}'), ("a", 1, '{"type": "new kind"}'), ("a", 2, '{"type": "result"}'), ("a", 3, '{"type": "error"}')]
    lines += [("b", 0, '{"type": "error", "message": ""}'), ("c", 0, '{"type": "error", "message": "m", "retryable": true}'), ("d", 0, '{"type": "heartbeat"}')]
    out = readers.upload_outcomes(spark.createDataFrame(lines, "stream string, line long, value string"))
    assert {r.stream: (r.outcome, r.message) for r in out.collect()} == {"a": ("result", None), "b": ("error", "unknown error"), "c": ("retry", "m"), "d": ("incomplete", None)}
    doc = '[{"path": "p", "hash": "old", "lfs": {"oid": "1"}, "size": 12345678901234567890}, {"path": "q", "hash": "old", "lfs": {"oid": "2"}}, {"path": "r", "x": null}]'
    rows = readers.tree_rows(spark.createDataFrame([("t", doc)], "name string, value string"))
    new = readers.rewritten_tree(rows, spark.createDataFrame([("1", "local")], "oid string, file string"), "hash").orderBy("ord").collect()
    import json

    docs = [json.loads(r.entry) for r in new]
    assert docs[0]["hash"] == "local" and docs[0]["size"] == 12345678901234567890 and "hash" not in docs[1] and docs[2] == {"path": "r", "x": None}
