import random

import numpy as np

from cairn.operators.split import split_plan


def plain(pieces, offset, length, min_terms, least):
    """Every boundary tried, byte counts by definition."""
    lo, hi, least = offset, offset + max(length, 0), max(least, 1)
    at, work = 0, []
    for i, p in enumerate(pieces):
        work.append([i, 0, list(p), at])
        at += sum(p)
    inside = lambda a, b: max(min(b, hi) - max(a, lo), 0)

    def cut(w):
        _, _, sizes, start = w
        end, best = start + sum(sizes), None
        for c in range(1, len(sizes)):
            x = start + sum(sizes[:c])
            if lo < x < hi and inside(start, x) >= least and inside(x, end) >= least:
                d = abs(2 * x - (max(start, lo) + min(end, hi)))
                if best is None or d < best[0]:
                    best = (d, c, x)
        return best

    while 1 < min_terms and len(work) < min_terms:
        able = [(inside(w[3], w[3] + sum(w[2])), -k) for k, w in enumerate(work) if cut(w)]
        if not able:
            break
        k = -max(able)[1]
        i, first, sizes, start = work[k]
        _, c, x = cut(work[k])
        work[k : k + 1] = [[i, first, sizes[:c], start], [i, first + c, sizes[c:], x]]
    return [(i, first, first + len(s)) for i, first, s, _ in work]


def test_equals_plain_version():
    rng = random.Random(6)
    for _ in range(300):
        pieces = [[rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        total = sum(map(sum, pieces))
        offset = rng.randrange(0, max(len(pieces[0]), 2))
        length, terms, least = rng.randrange(0, total + 5), rng.randrange(0, 12), rng.randrange(0, 25)
        got = split_plan([np.array(p) for p in pieces], [sum(p) for p in pieces], offset, length, terms, least)
        assert got == plain(pieces, offset, length, terms, least)


def test_unknown_chunks_stay_whole():
    assert split_plan([None, np.array([5, 5])], [100, 10], 0, 110, 3, 1) == [(0, 0, 1), (1, 0, 1), (1, 1, 2)]
