"""Byte-pair merges on short strings, and the compatibility of adjacent tokens.

A token sequence is the merge result of its text exactly if every adjacent
pair of it is the merge result of that pair's own text. All encoders here
rest on that rule; ``Pairs`` answers it for two tokens and remembers.
"""

from __future__ import annotations

PAIRS_KEPT = 500_000


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """The plain merge loop: lowest rank first, leftmost on ties. For short texts."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pairs(dict):
    """``pairs[a, b]``: whether tokens a and b stay apart as they are. Memoised, bounded."""

    def __init__(self, rank: dict[str, int]):
        super().__init__()
        self.rank = rank

    def __missing__(self, key: tuple[str, str]) -> bool:
        a, b = key
        if len(self) >= PAIRS_KEPT:
            self.clear()
        ok = self[key] = merge(a + b, self.rank) == [a, b]
        return ok
