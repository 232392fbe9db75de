"""Kernels against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from segmark.functions import editpath as ep
from segmark.functions.matching import match_counts, match_one
from segmark.operators.frames import viterbi

labels = st.lists(st.integers(0, 3), max_size=18)


def table(ref, hyp):
    d = np.zeros((len(ref) + 1, len(hyp) + 1), int)
    d[:, 0], d[0, :] = np.arange(len(ref) + 1), np.arange(len(hyp) + 1)
    for i, r in enumerate(ref, 1):
        for j, h in enumerate(hyp, 1):
            d[i, j] = min(d[i - 1, j - 1] + (r != h), d[i - 1, j] + 1, d[i, j - 1] + 1)
    return d


def brute_path(ref, hyp):
    d, i, j, out = table(ref, hyp), len(ref), len(hyp), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def as_list(path):
    return list(zip(path[0].tolist(), path[1].tolist()))


@given(st.lists(st.tuples(labels, labels), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_batched_paths(pairs):
    refs = [np.array(r, np.int32) for r, _ in pairs]
    hyps = [np.array(h, np.int32) for _, h in pairs]
    for (r, h), path, a, b in zip(pairs, ep.edit_paths(refs, hyps), refs, hyps):
        assert as_list(path) == brute_path(r, h)
        s, d, i = ep.edit_counts(a, b, path)
        assert s + d + i == table(r, h)[-1, -1]
        assert d - i == len(r) - len(h)


@given(labels, labels)
@settings(max_examples=150, deadline=None)
def test_single_long_path(ref, hyp):
    stride, ep._ROW_STRIDE = ep._ROW_STRIDE, 4
    try:
        assert as_list(ep._one(np.array(ref, np.int32), np.array(hyp, np.int32))) == brute_path(ref, hyp)
    finally:
        ep._ROW_STRIDE = stride


def test_backtrace_ties():
    run = lambda r, h: as_list(ep.edit_paths([np.array(r)], [np.array(h)])[0])
    assert run([1, 1], [1]) == [(0, -1), (1, 0)]
    assert run([1], [2]) == [(0, 0)]


def brute_hits(ref, hyp, tol):
    used, hits = set(), 0
    for r in ref:
        free = [(abs(h - r), j) for j, h in enumerate(hyp) if j not in used]
        if free and min(free)[0] <= tol:
            used.add(min(free)[1])
            hits += 1
    return hits


times = st.lists(st.integers(0, 60), max_size=25, unique=True).map(lambda x: np.array(sorted(x)) / 100)


@given(st.lists(st.tuples(times, times), min_size=1, max_size=5), st.sampled_from([0.0, 0.01, 0.02, 0.05, 0.2]))
@settings(max_examples=150, deadline=None)
def test_boundary_matching(pairs, tol):
    got = match_counts([r for r, _ in pairs], [h for _, h in pairs], tol)
    want = [brute_hits(r, h, tol) for r, h in pairs]
    assert got.tolist() == want
    assert [int((match_one(r, h, tol) >= 0).sum()) for r, h in pairs] == want


def test_boundary_examples():
    assert match_counts([np.array([0.0, 0.01])], [np.array([0.005])], 0.02).tolist() == [1]
    assert match_counts([np.array([0.0, 0.1, 0.2])], [np.array([0.01, 0.11, 0.5])], 0.02).tolist() == [2]


def all_paths(frames, classes):
    if frames == 0:
        yield []
        return
    for rest in all_paths(frames - 1, classes):
        for c in range(classes):
            yield rest + [c]


def collapsed(path, blank=0):
    return [c for k, c in enumerate(path) if c != blank and (k == 0 or path[k - 1] != c)]


@given(st.integers(1, 5), st.lists(st.integers(1, 2), max_size=3), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_viterbi_is_the_best_labelling(frames, targets, seed):
    log_probs = np.random.default_rng(seed).normal(size=(frames, 3))
    fitting = [p for p in all_paths(frames, 3) if collapsed(p) == targets]
    got = viterbi(log_probs, np.array(targets, int), 0)
    if not fitting:
        assert got is None
        return
    score = lambda p: sum(log_probs[t, c] for t, c in enumerate(p))
    assert collapsed(got.tolist()) == targets
    assert np.isclose(score(got.tolist()), max(map(score, fitting)))
