"""Token similarity by longest common subsequence. Runs in Python workers."""

from __future__ import annotations

import functools


@functools.lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """200 * LCS / (len(a) + len(b)), by bit-parallel rows."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_score(query: list[str], name: list[str]) -> float:
    return sum(max(ratio(q, n) for n in name) for q in query) / len(query) if query and name else 0.0
