"""What Catalyst cannot decide: independent components, representations, and how chains become tasks."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass

import numpy as np

from .spec import Block


def components(prior_block: Sequence[int], gram_block: Sequence[Hashable], blocks: Sequence[Block], residual_sampled: bool, splittable: bool = True) -> np.ndarray:
    """The component of each predictor, numbered by first appearance.

    Predictors depend on each other through a Gram block, through a quantity
    that a prior block samples for all its predictors, or through a sampled
    residual variance.  ``splittable`` is false where implicit centring couples
    all blocks.
    """
    p = len(prior_block)
    if residual_sampled or not splittable:
        return np.zeros(p, np.int64)
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b, g in zip(prior_block, gram_block, strict=True):
        a = find(("gram", g))
        if blocks[b].shares_sampled:
            root[a] = find(("prior", b))
    numbers: dict = {}
    return np.array([numbers.setdefault(find(("gram", g)), len(numbers)) for g in gram_block], np.int64)


@dataclass(frozen=True)
class Storage:
    """How a Gram block is kept in a task, and the bytes that takes."""

    kind: str  # dense, sparse, lower
    bytes: int


def storage_choices(size: int, entries: int) -> dict[str, int]:
    """Bytes of a block of ``size`` with ``entries`` non-zeros of both triangles."""
    lower = (entries + size) // 2
    return {"dense": 8 * size * size, "sparse": 12 * entries + 4 * (size + 1), "lower": 12 * lower + 4 * (size + 1)}


def plan_storage(blocks: Sequence[tuple[int, int]], how: str = "auto", limit: int = 1 << 30) -> tuple[list[Storage], bool]:
    """A representation for each (size, entries), and whether all fit the limit.

    ``speed`` takes the faster of dense and full sparse by their size, ``memory``
    the smallest; ``auto`` begins with speed and turns the blocks that save most
    to one triangle until the limit holds.
    """
    choices = [storage_choices(*b) for b in blocks]
    fast = [min(("dense", "sparse"), key=lambda k, c=c: c[k]) for c in choices]
    if how == "memory":
        fast = [min(c, key=c.get) for c in choices]
    elif how == "auto":
        total = sum(c[k] for c, k in zip(choices, fast, strict=True))
        for i in sorted(range(len(blocks)), key=lambda i: choices[i]["lower"] - choices[i][fast[i]]):
            if total <= limit or choices[i]["lower"] >= choices[i][fast[i]]:
                break
            total -= choices[i][fast[i]] - choices[i]["lower"]
            fast[i] = "lower"
    elif how != "speed":
        raise ValueError("storage must be auto, speed or memory")
    out = [Storage(k, c[k]) for c, k in zip(choices, fast, strict=True)]
    return out, sum(s.bytes for s in out) <= limit


def compression(size: int, span: int, entries: int) -> tuple[int, int]:
    """(type, bytes) of a strictly lower LD block: 0 keeps each column's run of ``span`` values in all, 1 lists its rows."""
    interval, indexed = 8 * span + 4 * (size + 1), 12 * entries + 4 * (size + 1)
    return (0, interval) if interval <= indexed else (1, indexed)
