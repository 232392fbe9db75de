"""Boundary matching kernel run inside tasks on Arrow batches.

Reference boundaries, in time order, each take the nearest unused hypothesis boundary no farther than
the tolerance; the earlier one wins a tie. This is a greedy rule, not a maximum matching.
"""

from __future__ import annotations

import numpy as np

#: Cells of the padded distance matrix a batch of short recordings may use.
_BATCH_CELLS = 1 << 21


def match_one(ref: np.ndarray, hyp: np.ndarray, tolerance: float, used: np.ndarray | None = None) -> np.ndarray:
    """Index of the hypothesis boundary each reference boundary takes, or -1.

    Both sides sorted. ``used`` marks hypothesis boundaries taken before the first row; it is updated.
    """
    used = np.zeros(len(hyp), bool) if used is None else used
    # One slot of slack on both sides: the bound itself is rounded, the test below is exact.
    lo = np.maximum(np.searchsorted(hyp, ref - tolerance, "left") - 1, 0)
    hi = np.minimum(np.searchsorted(hyp, ref + tolerance, "right") + 1, len(hyp))
    taken = np.full(len(ref), -1, np.int64)
    for i in range(len(ref)):
        if lo[i] >= hi[i]:
            continue
        gap = np.abs(hyp[lo[i] : hi[i]] - ref[i])
        gap[used[lo[i] : hi[i]]] = np.inf
        j = int(gap.argmin())
        if gap[j] <= tolerance:
            taken[i] = lo[i] + j
            used[lo[i] + j] = True
    return taken


def _match_many(refs: list[np.ndarray], hyps: list[np.ndarray], tolerance: float) -> np.ndarray:
    count = len(refs)
    n = np.array([len(r) for r in refs])
    m = np.array([len(h) for h in hyps])
    height, width = int(n.max(initial=0)), int(m.max(initial=0))
    hits = np.zeros(count, np.int64)
    if not height or not width:
        return hits
    ref = np.zeros((count, height))
    free = np.full((count, width), np.inf)
    for b in range(count):
        ref[b, : n[b]] = refs[b]
        free[b, : m[b]] = hyps[b]
    every = np.arange(count)
    for i in range(height):
        gap = np.abs(free - ref[:, i : i + 1])
        j = gap.argmin(axis=1)
        hit = (gap[every, j] <= tolerance) & (i < n)
        # A used boundary moves out of reach for good.
        free[every[hit], j[hit]] = np.inf
        hits += hit
    return hits


def match_counts(refs: list[np.ndarray], hyps: list[np.ndarray], tolerance: float) -> np.ndarray:
    """Number of matched boundaries of every recording."""
    size = np.array([max(len(r), 1) * max(len(h), 1) for r, h in zip(refs, hyps)], dtype=np.int64)
    width = np.array([max(len(h), 1) for h in hyps], dtype=np.int64)
    out = np.zeros(len(refs), np.int64)
    short = np.flatnonzero(size <= _BATCH_CELLS)
    for b in np.flatnonzero(size > _BATCH_CELLS):
        out[b] = int((match_one(refs[b], hyps[b], tolerance) >= 0).sum())
    short = short[np.argsort(width[short], kind="stable")]
    start = 0
    while start < len(short):
        stop = start + 1
        while stop < len(short) and (stop - start + 1) * width[short[stop]] <= _BATCH_CELLS:
            stop += 1
        group = short[start:stop]
        out[group] = _match_many([refs[b] for b in group], [hyps[b] for b in group], tolerance)
        start = stop
    return out
