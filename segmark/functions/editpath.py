"""Edit-path kernels run inside tasks on Arrow batches.

Unit-cost edit distance; the path is read back from the end and prefers keeping both labels, then
dropping a reference label, then inserting a hypothesis label. Which labels end up paired depends on
that preference, so every kernel here follows it.

A DP row is computed without an inner loop: with ``x`` the best of the diagonal and upper moves,
``row[j] = min(left + j, min_{k<=j}(x[k] - k) + j)`` is a running minimum.
"""

from __future__ import annotations

import numpy as np

KEEP, DROP, INSERT = 0, 1, 2

#: Cells of the padded direction cube a batch of short recordings may use (one byte each).
_BATCH_CELLS = 1 << 23
#: Rows between two remembered DP rows when one long recording is aligned alone.
_ROW_STRIDE = 256


def _next_row(above: np.ndarray, left: int, same: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One DP row for one recording: (row, directions)."""
    keep = above[:-1] + (1 - same)
    drop = above[1:] + 1
    best = np.minimum(keep, drop)
    best -= cols
    np.minimum.accumulate(best, out=best)
    np.minimum(best, left, out=best)
    best += cols
    row = np.empty_like(above)
    row[0] = left
    row[1:] = best
    step = np.where(best == keep, KEEP, np.where(best == drop, DROP, INSERT)).astype(np.uint8)
    return row, step


def sweep(ref: np.ndarray, hyp: np.ndarray, top: np.ndarray, left: np.ndarray, keep_every: int = 0):
    """Fill a rectangle of the DP table from its top row and left column.

    Returns (bottom row, right column, {row number: row} remembered every ``keep_every`` rows).
    """
    cols = np.arange(1, len(hyp) + 1, dtype=np.int64)
    row, right, remembered = top, np.empty(len(ref) + 1, np.int64), {0: top}
    right[0] = top[-1]
    for i in range(len(ref)):
        row, _ = _next_row(row, left[i + 1], hyp == ref[i], cols)
        right[i + 1] = row[-1]
        if keep_every and (i + 1) % keep_every == 0:
            remembered[i + 1] = row
    return row, right, remembered


def walk(ref: np.ndarray, hyp: np.ndarray, top: np.ndarray, left: np.ndarray, i: int, j: int):
    """Walk back from cell (i, j) of a rectangle until its top row or left column is reached.

    Directions are recomputed strip by strip from remembered rows, so memory stays far below one
    byte per cell. Returns (path from the entry cell on, entry row, entry column).
    """
    _, _, remembered = sweep(ref[:i], hyp[:j], top[: j + 1], left, _ROW_STRIDE)
    cols = np.arange(1, j + 1, dtype=np.int64)
    path: list[tuple[int, int]] = []
    while i > 0 and j > 0:
        base = ((i - 1) // _ROW_STRIDE) * _ROW_STRIDE
        row = remembered[base][: j + 1]
        steps = np.empty((i - base, j), np.uint8)
        for k in range(base, i):
            row, steps[k - base] = _next_row(row, left[k + 1], hyp[:j] == ref[k], cols[:j])
        while i > base and j > 0:
            step = steps[i - base - 1, j - 1]
            if step == KEEP:
                i, j = i - 1, j - 1
                path.append((i, j))
            elif step == DROP:
                i -= 1
                path.append((i, -1))
            else:
                j -= 1
                path.append((-1, j))
    path.reverse()
    return path, i, j


def _one(ref: np.ndarray, hyp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, m = len(ref), len(hyp)
    top = np.arange(m + 1, dtype=np.int64)
    left = np.arange(n + 1, dtype=np.int64)
    path, i, j = walk(ref, hyp, top, left, n, m)
    head = [(k, -1) for k in range(i)] + [(-1, k) for k in range(j)]
    both = np.array(head + path, dtype=np.int32).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _many(refs: list[np.ndarray], hyps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Align a batch of short recordings at once: one vector operation per DP row of the batch."""
    count = len(refs)
    n = np.array([len(r) for r in refs])
    m = np.array([len(h) for h in hyps])
    width, height = int(m.max(initial=0)), int(n.max(initial=0))
    hyp = np.full((count, width), -2, np.int32)
    ref = np.full((count, height), -1, np.int32)
    for b in range(count):
        hyp[b, : m[b]] = hyps[b]
        ref[b, : n[b]] = refs[b]
    cols = np.arange(1, width + 1, dtype=np.int32)
    steps = np.empty((height, count, width), np.uint8)
    above = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (count, width + 1))
    for i in range(height):
        keep = above[:, :-1] + (hyp != ref[:, i : i + 1])
        drop = above[:, 1:] + 1
        best = np.minimum(keep, drop) - cols
        np.minimum.accumulate(best, axis=1, out=best)
        np.minimum(best, i + 1, out=best)
        best += cols
        steps[i] = np.where(best == keep, KEEP, np.where(best == drop, DROP, INSERT))
        above = np.empty((count, width + 1), np.int32)
        above[:, 0] = i + 1
        above[:, 1:] = best
    i, j = n.copy(), m.copy()
    limit = int((n + m).max(initial=0))
    out_i = np.empty((limit, count), np.int32)
    out_j = np.empty((limit, count), np.int32)
    length = np.zeros(count, np.int64)
    every = np.arange(count)
    for k in range(limit):
        alive = (i > 0) | (j > 0)
        if not alive.any():
            break
        inner = (i > 0) & (j > 0)
        step = np.where(i > 0, DROP, INSERT)
        step[inner] = steps[i[inner] - 1, every[inner], j[inner] - 1]
        back_i = alive & (step != INSERT)
        back_j = alive & (step != DROP)
        i -= back_i
        j -= back_j
        out_i[k] = np.where(back_i, i, -1)
        out_j[k] = np.where(back_j, j, -1)
        length += alive
    return [(out_i[: length[b], b][::-1], out_j[: length[b], b][::-1]) for b in range(count)]


def edit_paths(refs: list[np.ndarray], hyps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edit path of every (ref, hyp) pair as two index arrays; -1 marks a missing side."""
    area = np.array([(len(r) + 1) * (len(h) + 1) for r, h in zip(refs, hyps)], dtype=np.int64)
    order = np.argsort(area, kind="stable")
    out: list = [None] * len(refs)
    start = 0
    while start < len(order):
        stop, height, width = start, 0, 0
        while stop < len(order):
            b = order[stop]
            h, w = max(height, len(refs[b])), max(width, len(hyps[b]))
            if stop > start and (stop - start + 1) * h * w > _BATCH_CELLS:
                break
            stop, height, width = stop + 1, h, w
        group = order[start:stop]
        if len(group) == 1 and area[group[0]] > _BATCH_CELLS:
            out[group[0]] = _one(refs[group[0]], hyps[group[0]])
        else:
            for b, path in zip(group, _many([refs[b] for b in group], [hyps[b] for b in group])):
                out[b] = path
        start = stop
    return out


def edit_counts(ref: np.ndarray, hyp: np.ndarray, path: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) along a path."""
    i, j = path
    both = (i >= 0) & (j >= 0)
    return int((ref[i[both]] != hyp[j[both]]).sum()), int((j < 0).sum()), int((i < 0).sum())
