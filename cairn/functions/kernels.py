"""Byte kernels: content-defined chunking, keyed hashes, Merkle roots, byte grouping, LZ4 frames, compression choice."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import blake3

# Sizes of chunks and containers, the cut mask, tree shape, keys of the hash domains.
MIN_CHUNK, MAX_CHUNK = 8192, 131072
CUT_MASK = 0xFFFF000000000000
MAX_CHUNKS, MAX_CONTAINER = 8192, 64 * 1024 * 1024
BRANCH, MAX_CHILDREN = 4, 9
DATA_KEY = bytes.fromhex("6697f5775b9550de3135cbaca597181c9de421109beb2b58b4d0b04b93adf229")
NODE_KEY = bytes.fromhex("017ec5c7a5472996fd946666b48a02e65ddd536f37c76dd2f86352e64a53713f")
FILE_KEY = bytes(32)
TERM_KEY = bytes.fromhex("7f1857d6ce56ed66127ff913e7a5c3f3a4cd26d5b5db49e64124987f28fb94c3")
ZERO = bytes(32)

#: The file a gear table is read from (256 little-endian words); unset, the table comes from a rule.
GEAR_CONF = "spark.cairn.gear.table"


@lru_cache
def gear_table(path: str | None = None) -> np.ndarray:
    """256 words of 64 bits. Stores that must agree on chunks must use the same table: pass the store's own as a file.

    The default is a rule: word i is the first 8 bytes of SHA-256 of "cairn gear" and the byte i.
    """
    if path:
        t = np.fromfile(path, "<u8")
        if len(t) != 256:
            raise ValueError(f"a gear table has 256 words, {path} has {len(t)}")
        return t
    return np.frombuffer(b"".join(hashlib.sha256(b"cairn gear" + bytes([i])).digest()[:8] for i in range(256)), "<u8")


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, from the 64 bytes up to it: older ones are shifted out. Doubling: six shift-adds."""
    h = table[data]
    with np.errstate(over="ignore"):
        for k in range(6):
            step = 1 << k
            h[step:] += h[:-step] << np.uint64(step)
    return h


def segment(candidates: np.ndarray, size: int, least: int, most: int) -> list[int]:
    """Ends of greedy segments: the first candidate end at least ``least`` after the last end, a forced one after ``most``."""
    ends, at = [], 0
    while at < size:
        k = np.searchsorted(candidates, at + least)
        nxt = int(candidates[k]) if k < len(candidates) else size
        at = min(nxt, at + most, size)
        ends.append(at)
    return ends


#: Bytes hashed at a time: their hashes stay in the processor's cache.
SLAB = 1 << 16


def chunk_ends(data: bytes, table: np.ndarray | None = None) -> list[int]:
    """Ends of the content-defined chunks of data."""
    table = gear_table() if table is None else table
    raw, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(raw), SLAB):
        lead = min(at, 63)  # a window of 64 bytes reaches back over the slab's start
        h = gear_hashes(raw[at - lead : at + SLAB], table)[lead:]
        found.append(np.flatnonzero((h & np.uint64(CUT_MASK)) == 0) + at + 1)
    return segment(np.concatenate(found) if found else np.zeros(0, np.int64), len(raw), MIN_CHUNK, MAX_CHUNK)


def chunks(data: bytes, table: np.ndarray | None = None) -> list[bytes]:
    ends = chunk_ends(data, table)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


# Hashes


def chunk_hashes(data: list[bytes]) -> list[bytes]:
    return blake3.keyed(data, DATA_KEY)


def hash_string(h: bytes) -> str:
    """Four words of 8 bytes, each printed from its last byte to its first."""
    return b"".join(h[i : i + 8][::-1] for i in range(0, 32, 8)).hex()


def parse_hash(s: str | None) -> bytes | None:
    """The hash of a string form; None for what is none."""
    try:
        raw = bytes.fromhex(s) if s is not None and len(s) == 64 else b""
    except ValueError:
        return None
    return b"".join(raw[i : i + 8][::-1] for i in range(0, 32, 8)) if len(raw) == 32 else None


def hmac(h: bytes, key: bytes) -> bytes:
    return blake3.keyed([h], key)[0]


def term_hash(hashes: list[bytes]) -> bytes:
    return blake3.keyed([b"".join(hashes)], TERM_KEY)[0]


def cut_here(h: bytes) -> bool:
    return h[24] % BRANCH == 0  # the last word is little-endian: its low byte decides


def merkle_groups(hashes: list[bytes]) -> list[int]:
    """Ends of the groups of one level: after the third to ninth node whose hash says so, else nine."""
    ends, at, n = [], 0, len(hashes)
    while at < n:
        left = min(MAX_CHILDREN, n - at)
        step = left if left <= 2 else next((i + 1 for i in range(2, left) if cut_here(hashes[at + i])), left)
        at += step
        ends.append(at)
    return ends


def merkle_root(nodes: list[tuple[bytes, int]]) -> bytes:
    """Root over (hash, size) leaves: none gives zeros, one gives its own hash."""
    if not nodes:
        return ZERO
    while len(nodes) > 1:
        ends = merkle_groups([h for h, _ in nodes])
        groups = [nodes[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        lines = ["".join(f"{hash_string(h)} : {size}\n" for h, size in g).encode() for g in groups]
        nodes = list(zip(blake3.keyed(lines, NODE_KEY), [sum(s for _, s in g) for g in groups], strict=True))
    return nodes[0][0]


def file_hash(nodes: list[tuple[bytes, int]]) -> bytes:
    return blake3.keyed([merkle_root(nodes)], FILE_KEY)[0] if nodes else ZERO


# Byte grouping and compression

RAW, LZ4, GROUPED = 0, 1, 2
GROUPED_ABOVE = 0.02


def group_bytes(data: bytes) -> bytes:
    """Bytes by their position modulo 4."""
    x = np.frombuffer(data, np.uint8)
    return b"".join(x[k::4].tobytes() for k in range(4))


def ungroup_bytes(data: bytes) -> bytes:
    x, out = np.frombuffer(data, np.uint8), np.empty(len(data), np.uint8)
    at = 0
    for k in range(4):
        n = len(range(k, len(data), 4))
        out[k::4] = x[at : at + n]
        at += n
    return out.tobytes()


_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def popcounts(data: bytes) -> np.ndarray:
    """(4, 9): how many bytes at each position modulo 4 have each number of bits."""
    ones = _POPCOUNT[np.frombuffer(data, np.uint8)]
    return np.stack([np.bincount(ones[k::4], minlength=9) for k in range(4)])


def divergence(data: bytes) -> float:
    """The largest Kullback-Leibler divergence of a position's bit counts from all positions' (plus 1 each, total without).
    An empty bin makes a position's sum not a number, which is never the largest."""
    counts = popcounts(data)
    pooled, total = (1 + counts.sum(axis=0)).tolist(), int(counts.sum())
    best = 0.0
    for row in counts.tolist():
        if min(row) == 0:
            continue
        n, kl = sum(row), 0.0
        for c, b in zip(row, pooled, strict=True):
            p = c / n
            kl += p * math.log(p / (b / total))
        best = max(best, kl)
    return best


def choose_scheme(data: bytes) -> int:
    return GROUPED if divergence(data) > GROUPED_ABOVE else LZ4


def lz4(data: bytes) -> bytes:
    return pa.compress(data, codec="lz4", asbytes=True)


def unlz4(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="lz4", asbytes=True)


def pack(data: bytes, scheme: int) -> tuple[bytes, int]:
    """Data compressed once by the scheme, or as it is where that is not smaller."""
    out = lz4(group_bytes(data) if scheme == GROUPED else data) if scheme else data
    return (out, scheme) if len(out) < len(data) else (data, RAW)


def unpack(body: bytes, size: int, scheme: int) -> bytes:
    if scheme == RAW:
        out = body
    elif scheme in (LZ4, GROUPED):
        out = unlz4(body, size)
        out = ungroup_bytes(out) if scheme == GROUPED else out
    else:
        raise ValueError(f"unknown compression {scheme}")
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes, {size} declared")
    return out
