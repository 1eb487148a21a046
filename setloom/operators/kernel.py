"""A prefix index in memory, for probing record by record: the kernel of streams and of grouped joins."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

GUARD = 1e-9


class PrefixIndex:
    """Sets of comparable tokens, already in the common order, found by the tokens of their prefixes."""

    def __init__(self, threshold: float, strict: bool = False) -> None:
        self.t, self.strict = threshold, strict
        self.sets: dict[int, list] = {}
        self.lists: dict[object, list[tuple[int, int, int]]] = defaultdict(list)

    def _prefix(self, n: int) -> int:
        return n - math.ceil(n * self.t - GUARD) + 1 if n else 0

    def add(self, rid: int, tokens: list) -> None:
        self.sets[rid] = tokens
        for i, tok in enumerate(tokens[: self._prefix(len(tokens))]):
            self.lists[tok].append((rid, i, len(tokens)))

    def probe(self, tokens: list) -> Iterator[tuple[int, int, float]]:
        """(rid, overlap, similarity) of the indexed sets that pass."""
        n = len(tokens)
        own = set(tokens)
        seen: set[int] = set()
        for j, tok in enumerate(tokens[: self._prefix(n)]):
            for rid, i, m in self.lists.get(tok, ()):
                if rid in seen or m < math.ceil(n * self.t - GUARD) or n < math.ceil(m * self.t - GUARD):
                    continue
                if min(i, j) + 1 + min(m - i - 1, n - j - 1) < math.ceil((m + n) * self.t / (1 + self.t) - GUARD):
                    continue
                seen.add(rid)
                shared = sum(x in own for x in self.sets[rid])
                sim = shared / (m + n - shared)
                if sim > self.t or (sim == self.t and not self.strict):
                    yield rid, shared, sim


def self_join(records: Iterable[tuple[int, list]], threshold: float, strict: bool = False) -> Iterator[tuple[int, int, int, float]]:
    """(rid1, rid2, overlap, similarity), each record probing those before it."""
    index = PrefixIndex(threshold, strict)
    for rid, tokens in records:
        for other, shared, sim in index.probe(tokens):
            yield min(rid, other), max(rid, other), shared, sim
        index.add(rid, tokens)
