"""The tiled path must give exactly what the one-task path gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.functions.editpath import edit_paths
from segmark.operators import anylength, large, metrics, seqalign
from segmark.suite.matching import rounded

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_tiled_scores_equal_one_task_scores(spark):
    store = fx.two_sided(spark, SF)
    whole = metrics.score(store, order="ord")
    counts, errors = large.score_large(store, metrics.DEFAULT_TOLERANCES, "ord", tile=32, block_seconds=1.0)
    names = [c for c in counts.columns]
    assert _rows(counts) == _rows(whole.files.select(*names))
    assert _rows(errors) == _rows(whole.errors.select(*errors.columns))


def sequences(rng, n, wrong, shift):
    """Reference labels and a hypothesis with a share of edits and a block of ``shift`` further labels."""
    ref = [rng.choice("abcdefgh") for _ in range(n)]
    hyp = []
    for x in ref:
        r = rng.random()
        if r < wrong / 3:
            continue
        hyp.append(rng.choice("abcdefgh") if r < 2 * wrong / 3 else x)
        if 2 * wrong / 3 <= r < wrong:
            hyp.append(rng.choice("abcdefgh"))
    at = rng.randrange(len(hyp) + 1)
    return ref, hyp[:at] + [rng.choice("abcdefgh") for _ in range(shift)] + hyp[at:]


def pairs_of(ref, hyp):
    codes = [np.array([ord(c) for c in x]) for x in (ref, hyp)]
    (path,) = edit_paths([codes[0]], [codes[1]])
    return sorted((int(i), int(j)) for i, j in zip(*path) if i >= 0 and j >= 0)


def test_bands_find_the_path_of_the_whole_table(spark):
    """Few and many edits, long insertions, either side longer: the same pairs; bands grow only where they must."""
    rng = random.Random(3)
    cases = {f"u{k}": sequences(rng, n, wrong, shift) for k, (n, wrong, shift) in enumerate([(100, 0.05, 0), (90, 0.9, 0), (20, 0.2, 60), (80, 0.0, 0), (5, 0.5, 0), (90, 0.3, 20)])}
    cases["w"] = cases["u2"][::-1]
    cases["all"] = (["a"] * 70, ["b"] * 60)
    rows = [(u, s, k, x) for u, (ref, hyp) in cases.items() for s, seq in (("ref", ref), ("hyp", hyp)) for k, x in enumerate(seq)]
    labels = spark.createDataFrame(rows, "utt string, side string, pos long, phoneme string")
    got = {u: [] for u in cases}
    for r in large.tiled_pairs(labels, tile=16).collect():
        got[r.utt].append((r.ref_idx, r.hyp_idx))
    assert {u: sorted(x) for u, x in got.items()} == {u: pairs_of(*x) for u, x in cases.items()}


def test_tiles_filled_and_sides_read_grow_with_the_length(spark, monkeypatch):
    """Of alike sequences only tiles beside the diagonal are filled, and each wave's sides are read once."""
    filled = []
    own = large._fill

    def watched(grid, refs, hyps, folder, waves, tile):
        own(grid, refs, hyps, folder, waves, tile)
        filled.append(sum(spark.read.parquet(f"{folder}/w={w}").count() for w in range(waves)))

    monkeypatch.setattr(large, "_fill", watched)
    for n in (80, 160):
        ref = [str(k % 7) for k in range(n)]
        rows = [("u", s, k, x) for s in ("ref", "hyp") for k, x in enumerate(ref)]
        assert large.tiled_pairs(spark.createDataFrame(rows, "utt string, side string, pos long, phoneme string"), tile=16).count() == n
    assert len(filled) == 2 and filled[0] <= 3 * 5 and filled[1] <= 3 * 10


def test_report_mixes_short_and_long_recordings(spark):
    store = fx.two_sided(spark, SF)
    sizes = store.groupBy("utt", "side").count().agg(F.expr("percentile_disc(0.5) within group (order by count)")).first()[0]
    mixed = metrics.score(store, metrics.ScoreOptions(max_one_task=int(sizes)), "ord")
    whole = metrics.score(store, metrics.ScoreOptions(), "ord")
    assert _rows(rounded(metrics.report(mixed))) == _rows(rounded(metrics.report(whole)))


def test_labels_with_blanks_count_as_words_in_the_tiled_path(spark):
    rows = [("u", "u.wav", "g", s, k, p, float(k), k + 0.5) for s, seq in
            (("ref", ["ab cd", "e", "f g", "h"]), ("hyp", ["ab", "e", "f g"])) for k, p in enumerate(seq)]
    store = spark.createDataFrame(
        rows, "utt string, file string, style string, side string, pos long, phoneme string, start_s double, end_s double"
    )
    counts, _ = large.score_large(store, [0.02], "pos", tile=2)
    short = seqalign.align(seqalign.gather(store)).select("s", "d", "i").first()
    assert tuple(counts.select("s", "d", "i").first()) == tuple(short)
    assert sum(short) == 2


def test_any_length_operators(spark):
    store = fx.two_sided(spark, SF)
    sizes = store.groupBy("utt", "side").count().agg(F.expr("percentile_disc(0.5) within group (order by count)")).first()[0]
    limit = int(sizes)
    for run in (
        lambda n: anylength.pair_rows(store, "ord", limit=n),
        lambda n: anylength.matched_times(store, "ord", limit=n),
        lambda n: anylength.boundary_counts(store, [0.02], "ord", limit=n),
        lambda n: anylength.label_error_rate(store, "ord", limit=n),
    ):
        assert _rows(run(limit)) == _rows(run(1 << 15))


def test_long_recordings_take_the_broadcast_join(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "utt string, x int")
    facts = spark.createDataFrame([("a", 2), ("b", 1)], "utt string, n int")
    got = [large.join_facts(rows, facts, F.col("n") > 1, longest, 1) for longest in (1, 2)]
    assert _rows(got[0]) == _rows(got[1]) and got[0].count() == 3
