"""Plain versions of operators, for tests."""

import re
from collections import Counter

from cairn.llm.op8_decontaminate import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ledger(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    rep = {p for i, g in enumerate(tri) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    chars, sym = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    other = 10 * sym > len(w) or chars < 2 * len(w) or chars > 15 * len(w) or len(lines) >= 10 and 2 * dup > len(lines)
    return len(w), chars, sym, dup, len(rep), base, not base and not other


def hits(text, items, window=10):
    """n_words, hit positions, ids of items that occur."""
    w = words((text or "").encode())
    pos, ids = set(), set()
    for item, t in items:
        v = words((t or "").encode())
        if item is None or not v:
            continue
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                pos |= set(range(i, i + n))
                ids.add(str(item))
    return len(w), pos, ids
