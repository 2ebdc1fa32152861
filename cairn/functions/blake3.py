"""Keyed BLAKE3 over many inputs at once, in numpy.

The 1 KiB pieces of all inputs are compressed side by side: numpy runs each step of the compression over all of them. The
tree above is joined level by level, again over all inputs at once.
"""

from __future__ import annotations

import numpy as np

# Fixed values of BLAKE3: the initial state, the message permutation and the domain flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16

PIECE, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(a, b, c, d, x, y):
    a += b + x
    d[:] = _turn(d ^ a, 16)
    c += d
    b[:] = _turn(b ^ c, 12)
    a += b + y
    d[:] = _turn(d ^ a, 8)
    c += d
    b[:] = _turn(b ^ c, 7)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv (8, n), words (16, n): the next chaining values (8, n)."""
    n = cv.shape[1]
    a, b = cv[:4].copy(), cv[4:].copy()
    c = np.repeat(IV[:4, None], n, axis=1)
    d = np.stack([(counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)])
    m = words
    for r in range(7):
        _mix(a, b, c, d, m[0:8:2], m[1:8:2])
        b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
        _mix(a, b, c, d, m[8:16:2], m[9:16:2])
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
        if r < 6:
            m = m[PERMUTATION]
    return np.concatenate([a ^ c, b ^ d])


def _pieces(data: list[bytes], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values (8, pieces) of all inputs' pieces in order, and the number of pieces of each input."""
    sizes = np.array([len(x) for x in data], np.int64)
    count = np.maximum(-(-sizes // PIECE), 1)
    total = int(count.sum())
    padded = np.zeros(total * PIECE, np.uint8)
    at = np.concatenate([[0], np.cumsum(count)])
    for x, start in zip(data, at[:-1].tolist(), strict=True):
        padded[start * PIECE : start * PIECE + len(x)] = np.frombuffer(x, np.uint8)
    words = padded.view("<u4").reshape(total, PIECE // BLOCK, 16).transpose(1, 2, 0)
    which = np.arange(total) - np.repeat(at[:-1], count)
    length = np.clip(np.repeat(sizes, count) - which * PIECE, 0, PIECE)
    blocks = np.maximum(-(-length // BLOCK), 1)
    alone = np.repeat(count, count) == 1
    cv = np.repeat(key[:, None], total, axis=1)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = KEYED + CHUNK_START * (k == 0) + np.where(last, CHUNK_END + ROOT * alone[on], 0)
        size = np.where(last, length[on] - k * BLOCK, BLOCK)
        cv[:, on] = _compress(np.ascontiguousarray(cv[:, on]), np.ascontiguousarray(words[k][:, on]), which[on].astype(np.uint64), size, flags)
    return cv, count


def keyed(data: list[bytes], key: bytes) -> list[bytes]:
    """32-byte keyed hashes of the inputs."""
    if not data:
        return []
    k = np.frombuffer(key, "<u4").astype(np.uint32)
    with np.errstate(over="ignore"):
        cv, count = _pieces(data, k)
        while (count > 1).any():
            starts = np.concatenate([[0], np.cumsum(count)])[:-1]
            pairs, odd = count // 2, count % 2
            left = np.concatenate([s + 2 * np.arange(p) for s, p in zip(starts, pairs, strict=True)]).astype(np.int64)
            top = np.repeat((count == 2), pairs)
            n = len(left)
            words = np.concatenate([cv[:, left], cv[:, left + 1]])
            joined = _compress(np.repeat(k[:, None], n, axis=1), words, np.zeros(n, np.uint64), np.full(n, BLOCK), KEYED + PARENT + ROOT * top)
            new = pairs + odd
            out = np.empty((8, int(new.sum())), np.uint32)
            to = np.concatenate([[0], np.cumsum(new)])[:-1]
            out[:, np.concatenate([t + np.arange(p) for t, p in zip(to, pairs, strict=True)]).astype(np.int64)] = joined
            rest = odd.astype(bool)
            out[:, (to + pairs)[rest]] = cv[:, (starts + count - 1)[rest]]
            cv, count = out, new
    return [cv[:, i].astype("<u4").tobytes() for i in range(cv.shape[1])]
