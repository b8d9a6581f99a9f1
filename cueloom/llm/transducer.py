"""A minimal acyclic transducer over bytes: sorted terms in, lexicographic ordinals out.

Equal subtrees are stored once, and an arc carries how many terms it skips, so the sum along a term's path is its place
in the sorted list.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """Maps each of its terms to 0, 1, 2, ... in byte order; other byte strings to -1."""

    def __init__(self, arcs: dict[int, tuple[int, int]], final: np.ndarray):
        self._arcs, self._final = arcs, final
        self._root = len(final) - 1

    @property
    def n_states(self) -> int:
        return len(self._final)

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in byte order, one at a time: a state is closed once no later term can reach it."""
        known: dict[tuple, int] = {}
        below: list[int] = []
        arcs: dict[int, tuple[int, int]] = {}
        final: list[bool] = []
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
        last: bytes | None = None

        def number(state) -> int:
            ends, out = state[0][0], tuple(state[1])
            at = known.setdefault((ends, out), len(below))
            if at == len(below):
                skipped = int(ends)
                for label, target in out:
                    arcs[at << 8 | label] = (target, skipped)
                    skipped += below[target]
                below.append(skipped)
                final.append(ends)
            return at

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                target = number(path.pop())
                path[-1][1].append((last[len(path) - 1], target))

        for term in terms:
            common = 0
            if last is not None:
                if term <= last:
                    raise ValueError(f"terms are not distinct and in byte order: {last!r}, {term!r}")
                most = min(len(last), len(term))
                while common < most and last[common] == term[common]:
                    common += 1
                close(common)
            path.extend(([False], []) for _ in range(len(term) - common))
            path[-1][0][0] = True
            last = term
        close(0)
        number(path[0])
        return cls(arcs, np.array(final, bool))

    def ordinal(self, term: bytes) -> int:
        at, place, arcs = self._root, 0, self._arcs
        for byte in term:
            step = arcs.get(at << 8 | byte)
            if step is None:
                return -1
            at = step[0]
            place += step[1]
        return place if self._final[at] else -1

    def dump(self) -> bytes:
        steps = np.array([(k, *v) for k, v in self._arcs.items()], np.int64).reshape(-1, 3)
        out = io.BytesIO()
        np.savez(out, steps=steps if steps.size and steps.max() >= 2**31 else steps.astype(np.int32), final=self._final)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data)) as z:
            steps, final = z["steps"], z["final"]
        return cls({k: (t, o) for k, t, o in steps.tolist()}, final)
