import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions import blake3
from cairn.functions import kernels as K


def plain_chunk_ends(data, table):
    """The rule, byte by byte."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(table[b])) & (2**64 - 1)
        n = i + 1 - start
        if n >= K.MIN_CHUNK and (h & K.CUT_MASK) == 0 or n == K.MAX_CHUNK:
            ends.append(i + 1)
            start, h = i + 1, 0
    return ends if not data or ends and ends[-1] == len(data) else [*ends, len(data)]


def test_chunk_ends_equal_the_rule(monkeypatch):
    table = K.gear_table()
    for seed, n in ((1, 600_000), (2, 9000), (3, 8191), (4, 0)):
        data = random.Random(seed).randbytes(n)
        assert K.chunk_ends(data, table) == plain_chunk_ends(data, table)
    assert K.chunk_ends(b"\7" * 300_000, table)[-1] == 300_000
    data = random.Random(5).randbytes(400_000)
    want = K.chunk_ends(data, table)
    monkeypatch.setattr(K, "SLAB", 70_001)
    assert K.chunk_ends(data, table) == want
    assert b"".join(K.chunks(data, table)) == data


def test_gear_table_from_a_file(tmp_path):
    (tmp_path / "t").write_bytes(np.arange(256, dtype="<u8").tobytes())
    assert K.gear_table(str(tmp_path / "t")).tolist() == list(range(256))
    (tmp_path / "bad").write_bytes(b"1234")
    with pytest.raises(ValueError):
        K.gear_table(str(tmp_path / "bad"))


@pytest.mark.skipif("PUBLISHED_GEAR_TABLE" not in os.environ, reason="needs the published table as a file")
def test_published_boundaries():
    t = K.gear_table(os.environ["PUBLISHED_GEAR_TABLE"])
    assert K.chunk_ends(bytes([59]) * 1_000_000, t) == [*(131072 * i for i in range(1, 8)), 1_000_000]


def test_published_hashes():
    assert K.hash_string(K.chunk_hashes([b"Hello World!"])[0]) == "d8d408e608fb9ca213b9909a65d86d725f2de4d8d540324be8a363e7a6e228cb"
    assert K.hash_string(bytes(range(32))) == "07060504030201000f0e0d0c0b0a090817161514131211101f1e1d1c1b1a1918"
    assert K.parse_hash("07060504030201000f0e0d0c0b0a090817161514131211101f1e1d1c1b1a1918") == bytes(range(32))
    assert K.parse_hash("07") is K.parse_hash("g" * 64) is K.parse_hash(None) is None


def test_published_node_and_term_hashes():
    nodes = ["c28f58387a60d4aa200c311cda7c7f77f686614864f5869eadebf765d0a14a69", "6e4e3263e073ce2c0e78cc770c361e2778db3b054b98ab65e277fc084fa70f22"]
    root = K.merkle_root([(K.parse_hash(nodes[0]), 100), (K.parse_hash(nodes[1]), 200)])
    assert K.hash_string(root) == "be64c7003ccd3cf4357364750e04c9592b3c36705dee76a71590c011766b6c14"
    raw = ["aad4607a38588fc2777f7cda1c310c209e86f564486186f6694aa1d065f7ebad", "2cce73e063324e6e271e360c77cc780e65ab984b053bdb78220fa74f08fc77e2"]
    assert K.hash_string(K.term_hash([bytes.fromhex(x) for x in raw])) == "eb06a8ad81d588ac05d1d9a079232d9c1e7d0b07232fa58091caa7bf333a2768"


def test_keyed_hash_equals_the_jvm(spark):
    jvm = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3072, 5000, 8192, 16385, 40000]
    data = [random.Random(n).randbytes(n) for n in sizes]
    for key in (K.DATA_KEY, K.FILE_KEY):
        want = []
        for d in data:
            h = jvm.initKeyedHash(bytearray(key))
            h.update(bytearray(d))
            want.append(bytes(h.doFinalize(32)))
        assert blake3.keyed(data, key) == want
    assert blake3.keyed([], K.DATA_KEY) == []


def plain_root(nodes):
    if not nodes:
        return K.ZERO
    while len(nodes) > 1:
        out, i = [], 0
        while i < len(nodes):
            n = min(9, len(nodes) - i)
            if n > 2:
                for j in range(2, n):
                    if int.from_bytes(nodes[i + j][0][24:], "little") % 4 == 0:
                        n = j + 1
                        break
            group = nodes[i : i + n]
            text = "".join(f"{K.hash_string(h)} : {s}\n" for h, s in group)
            out.append((blake3.keyed([text.encode()], K.NODE_KEY)[0], sum(s for _, s in group)))
            i += n
        nodes = out
    return nodes[0][0]


def test_merkle_root():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 9, 10, 100, 777):
        nodes = [(rng.randbytes(32), rng.randrange(1, 9000)) for _ in range(n)]
        assert K.merkle_root(nodes) == plain_root(nodes)
    leaf = (rng.randbytes(32), 5)
    assert K.merkle_root([leaf]) == leaf[0] and K.file_hash([leaf]) == blake3.keyed([leaf[0]], K.FILE_KEY)[0] and K.file_hash([]) == K.ZERO


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trips(data):
    assert K.ungroup_bytes(K.group_bytes(data)) == data
    for scheme in (K.LZ4, K.GROUPED):
        body, used = K.pack(data, scheme)
        assert len(body) <= len(data) and K.unpack(body, len(data), used) == data


def test_divergence_equals_the_formula():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) if i % 4 else rng.randrange(16) for i in range(40001))
    hist = [[0] * 9 for _ in range(4)]
    for i, b in enumerate(data):
        hist[i % 4][bin(b).count("1")] += 1
    assert K.popcounts(data).tolist() == hist
    base = [1 + sum(h[j] for h in hist) for j in range(9)]
    best = 0.0
    for h in hist:
        kl = sum(math.nan if c == 0 else c / sum(h) * math.log(c / sum(h) / (base[j] / len(data))) for j, c in enumerate(h))
        best = kl if kl > best else best
    assert abs(K.divergence(data) - best) < 1e-12 and K.divergence(b"") == 0.0
    assert K.choose_scheme(random.Random(1).randbytes(65536)) == K.LZ4
