"""Searches inside one pair of module sets, in plain Python.

They are sequential by nature and run in executors, one group of rows a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Edges = dict[str, set[str]]


def adjacency(pairs: Iterable[tuple[str, str]]) -> tuple[Edges, Edges]:
    """Successors and predecessors."""
    out: Edges = {}
    into: Edges = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    return out, into


def reach(edges: Edges, starts: Iterable[str], stop_at: set[str] | None = None) -> set[str]:
    """All that lies behind the starts, without them; with ``stop_at``, no further than the first level that meets it."""
    first = set(starts)
    seen, level = set(first), first
    while level:
        level = {b for a in level for b in edges.get(a, ())} - seen
        seen |= level
        if stop_at is not None and level & stop_at:
            break
    return seen - first


class Search:
    """Shortest chains from ``heads`` to ``tails`` around ``barred`` modules, over edges that can be hidden."""

    def __init__(self, out: Edges, into: Edges, heads: set[str], tails: set[str], barred: set[str] = frozenset()):
        # only modules between both ends can lie on a chain
        ahead = self._closure(out, heads, barred)
        between = ahead & self._closure(into, tails, barred)
        pairs = [(a, b) for a in between for b in out.get(a, ()) if b in between]
        self._greedy = Greedy.of_columns(*(pa.array(side, pa.string()) for side in (zip(*pairs) if pairs else ((), ()))), heads, tails)

    @staticmethod
    def _closure(edges: Edges, starts: set[str], barred: set[str]) -> set[str]:
        seen = set(starts)
        level = seen
        while level:
            level = {b for a in level for b in edges.get(a, ())} - seen - barred
            seen |= level
        return seen

    def shortest(self) -> tuple[str, ...] | None:
        """Of the shortest chains, the smallest by name, from its head on."""
        return next(self._greedy.chains(), None)

    def all_shortest(self) -> list[tuple[str, ...]]:
        """A shortest chain, then one without its edges, and so on until none is left."""
        return list(self._greedy.chains())


class Greedy:
    """The greedy search over numbered modules, in about 50 bytes an edge.

    Numbers follow the order of names.  Hidden edges only make ways longer, so all
    chains of one length lie on the shortest ways at the time of the first of them:
    a search back from the tails per length, not per chain, and walks that never
    try an edge twice, since what leads nowhere once does so until the next length.
    """

    def __init__(self, names: pa.Array, source: np.ndarray, target: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        self.names, self.tails = names, tails
        count = len(names)
        self.is_head, is_tail = np.zeros(count, bool), np.zeros(count, bool)
        self.is_head[heads], is_tail[tails] = True, True
        # a shortest chain meets heads and tails at its ends only
        useful = ~is_tail[source] & ~self.is_head[target]
        source, target = source[useful], target[useful]
        order = np.lexsort((target, source))
        self.source, self.target = source[order], target[order]
        self.start = np.zeros(count + 1, np.int64)
        np.cumsum(np.bincount(self.source, minlength=count), out=self.start[1:])
        self.into = np.argsort(self.target, kind="stable")
        self.into_start = np.zeros(count + 1, np.int64)
        np.cumsum(np.bincount(self.target, minlength=count), out=self.into_start[1:])
        self.left = np.ones(len(self.source), np.uint8)

    @classmethod
    def of_columns(cls, importer, imported, heads, tails) -> Greedy:
        both = [pc.unique(c) for c in (importer, imported)]
        names = pc.unique(pa.concat_arrays(both))
        names = names.take(pc.array_sort_indices(names))
        number = lambda c: pc.index_in(c, value_set=names).to_numpy()
        ends = [pc.index_in(pa.array(list(s), pa.string()), value_set=names).drop_null().to_numpy() for s in (heads, tails)]
        return cls(names, number(importer), number(imported), *ends)

    def _distances(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Steps to the tails (-1: further than any chain starts), and the heads that are nearest to them."""
        distance = np.full(len(self.names), -1, np.int32)
        distance[self.tails] = 0
        level, n = np.unique(self.tails), 0
        while len(level):
            n += 1
            first, size = self.into_start[level], self.into_start[level + 1] - self.into_start[level]
            edges = self.into[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
            level = self.source[edges[self.left[edges] == 1]]
            level = np.unique(level[distance[level] < 0])
            distance[level] = n
            if len(found := level[self.is_head[level]]):
                return n, distance, found
        return n, distance, level

    def chains(self) -> Iterator[tuple[str, ...]]:
        """Each chain is hidden before the next is sought."""
        target, start, left = memoryview(self.target), memoryview(self.start), memoryview(self.left)
        while True:
            length, distances, heads = self._distances()
            if not len(heads):
                return
            distance = memoryview(distances)
            at: dict[int, int] = {}  # the edge to try next, by module
            for head in heads.tolist():
                way = [head]
                while way:
                    here, ahead = way[-1], length - len(way)
                    if ahead < 0:
                        for a in way[:-1]:
                            left[at[a]] = 0
                            at[a] += 1
                        yield tuple(self.names.take(pa.array(way)).to_pylist())
                        way = [head]
                        continue
                    edge, end = at.get(here, start[here]), start[here + 1]
                    while edge < end and not (left[edge] and distance[target[edge]] == ahead):
                        edge += 1
                    at[here] = edge
                    if edge < end:
                        way.append(target[edge])
                    else:
                        way.pop()
                        if way:
                            at[way[-1]] += 1
