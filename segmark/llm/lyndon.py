"""Suffix sorting of many texts at once by linear grouping.

First every suffix is put into the group of its longest Lyndon prefix. Groups are settled from the largest to the
smallest: each settled group prolongs the prefixes of the suffixes that its members point to, their nearest
neighbours to the left in a smaller group, and those form new groups, ordered by how many members point at them.
Then the order inside the groups is emitted from the smallest suffix on: what a suffix follows is the next of its
group. Nothing is renamed and nothing recurses. All texts of a batch take each step together as numpy arrays, so
that the cost of a step is shared; a batch should hold texts of similar length.
"""

from __future__ import annotations

import numpy as np

from segmark.llm.common import ranges


def suffix_orders(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffixes of texts that lie one after another in ``symbols``, sorted within each text.

    ``lengths`` are those of the texts, all above 0. The result has the absolute starts of the sorted suffixes,
    text after text. An end of text sorts before every symbol.
    """
    n = len(symbols)
    base = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(text * (int(symbols.max(initial=0)) + 1) + symbols, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts = np.flatnonzero(np.append(True, (text[order][1:] != text[order][:-1]) | (symbols[order][1:] != symbols[order][:-1]))) if n else np.zeros(0, np.int64)
    group = np.empty(n, np.int64)  # of each suffix: where its group begins in `order`
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    end = np.zeros(n + 1, np.int64)  # of each group by its beginning
    end[starts] = np.append(starts[1:], n)
    left = np.arange(n) - 1  # pointers; settled ones lead to a smaller group
    marked = np.zeros(n, bool)

    top = base + lengths
    live = np.flatnonzero(lengths > 0)
    while len(live):
        stop = top[live]
        first = group[order[stop - 1]]
        size = stop - first
        top[live] = first
        own = order[ranges(first, size)]
        lower, bottom = np.repeat(first, size), np.repeat(base[live], size)
        at = left[own]
        move = np.flatnonzero((at >= bottom) & (group[at] >= lower))
        while len(move):
            at[move] = left[at[move]]
            left[own[move]] = at[move]
            rest = at[move]
            move = move[(rest >= bottom[move]) & (group[rest] >= lower[move])]
        at = np.sort(at[at >= bottom])
        live = live[first > base[live]]
        if not len(at):
            continue
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        times = np.diff(np.append(new, len(at)))
        at = at[new]
        home = group[at]
        by = np.lexsort((times, home))
        at, times, home = at[by], times[by], home[by]
        head = np.append(True, home[1:] != home[:-1])
        heads = np.flatnonzero(head)
        many = np.diff(np.append(heads, len(at)))
        kept_end = end[home[heads]] - many  # where what stays in a group ends
        slots = ranges(kept_end, many)
        # The last places of a group go to the suffixes that move up; what stands there takes the places they leave.
        marked[at] = True
        there = order[slots]
        out = there[~marked[there]]
        was = place[at]
        free = np.sort(was[was < np.repeat(kept_end, many)])
        order[free], place[out] = out, free
        order[slots], place[at] = at, slots
        marked[at] = False
        end[home[heads]] = kept_end
        cuts = np.flatnonzero(head | np.append(True, times[1:] != times[:-1]))
        begins = slots[cuts]
        run = np.diff(np.append(cuts, len(at)))
        group[at] = np.repeat(begins, run)
        end[begins] = begins + run

    # The empty suffix comes first in each text; then each sorted suffix places the suffixes it follows.
    done, front = np.zeros(n, bool), np.arange(n)
    result = np.empty(n, np.int64)
    suffix, step, live = base + lengths, 0, np.flatnonzero(lengths > 0)
    suffix = suffix[live]
    while len(live):
        at, low = suffix - 1, base[live]
        while True:
            go = at >= low
            go[go] = ~done[at[go]]
            at, low = at[go], low[go]
            if not len(at):
                break
            done[at] = True
            where = front[group[at]]
            result[where] = at
            front[group[at]] = where + 1
            at = left[at]
        live = live[step < lengths[live]]
        suffix = result[base[live] + step]
        step += 1
    return result
