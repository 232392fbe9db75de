"""Hand-written rows through the Spark operators."""

import functools
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from segmark import fixtures as fx
from segmark.functions import guarded
from segmark.functions import labels as L
from segmark.functions import text
from segmark.operators import frames as fr
from segmark.operators import intervals as iv
from segmark.operators import labels as lab
from segmark.operators import anylength, metrics, quantiles, scan, seqalign, vad
from segmark.operators.boundaries import tolerance_tags, with_boundary_counts
from segmark.plans import evaluation

STORE = "utt string, file string, style string, side string, pos long, phoneme string, start_s double, end_s double"


def store(spark, ref, hyp, utt="u", style="g"):
    rows = [(utt, f"{utt}.wav", style, side, k, *item) for side, seq in (("ref", ref), ("hyp", hyp)) for k, item in enumerate(seq)]
    return spark.createDataFrame(rows, STORE)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def normal(spark, rules, items):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, label string")
    return [r["phoneme"] for r in lab.normalized(df, "label", rules).orderBy("k").collect()]


# ---- labels -------------------------------------------------------------------------------------


def test_general_rules(spark):
    none = L.PRESETS["none"]
    items = ["a", " b c ", "sil", "SP", "[x]", "[[x]] y", "(p) q", "*r* s", "t xPauseY", "u\nremark", "́", "", None, "aː", "##"]
    assert normal(spark, none, items) == ["a", "bc", None, None, None, "y", "q", "s", "t", "u", None, None, None, "a", None]


def test_composition_and_nasals(spark):
    french = L.french_rules("reference")
    got = normal(spark, french, ["ã", "ɑ̃̃", "tʁ", "a~", "Z=", "euh", "õ", "E"])
    assert got == ["ɑ̃", "ɑ̃", "t", "ɑ̃", "ʒ", None, None, "ɛ"]


def test_sampa_and_broad_presets(spark):
    assert normal(spark, L.PRESETS["french-sampa"], ["@t", "R", "?", "a?", "<p:>", "t R", "fe~", "SIL", "o~", "sp"]) == [
        "ə", "ʁ", None, "a", None, "t", None, None, "ɔ̃", "s"]
    assert normal(spark, L.PRESETS["french-broad"], ["ɹ", "ñ", "mʲ", "m=", "θ", "ts"]) == ["ʁ", "ɲ", "m", "m=", "t", "t"]


def test_asr_preset(spark):
    asr = L.PRESETS["french-asr-codes"]
    items = ["jj", "yu", "nn+yy", "x NB sur tDeb", "#aa", "kk+", "*z* aa", "[ pause ]", "SIL", "euh", "ab  cd", "NONCORR tt"]
    assert normal(spark, asr, items) == ["ʒ", "ɥ", "n", "e", "a", "k", " aa", None, "_", None, "ab cd", "t"]


def test_replaced_mapping_and_sequences(spark):
    rules = L.build_rules("french-sampa", {"x": "y"})
    assert normal(spark, rules, ["x", "R"]) == ["y", "R"]
    df = spark.createDataFrame([(" a  sil b̃ ",)], "s string").withColumn("c", text.compose("s"))
    assert df.select(lab.normalize_sequence(F.col("s"), F.col("c"), L.PRESETS["none"])).first()[0] == "a b̃"
    df = spark.createDataFrame([(["a", "sil", "b c"],), ([],)], "s array<string>")
    df = df.withColumn("c", text.compose(F.array_join("s", "\x00")))
    got = [r[0] for r in df.select(lab.normalize_label_list(F.col("s"), L.PRESETS["none"], F.col("c"))).collect()]
    assert got == [["a", "bc"], []]


def test_row_path_equals_broadcast_path(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "[b]", "sil", None, "ñ"]], "label string")
    a = values(lab.normalize_labels(df, "label", L.PRESETS["none"]), "label", "phoneme")
    b = values(lab.normalize_labels(df, "label", L.PRESETS["none"], max_vocabulary=1), "label", "phoneme")
    assert a == b


# ---- alignment and metrics ----------------------------------------------------------------------


def test_word_counts_for_labels_with_blanks(spark):
    rows = seqalign.align(seqalign.gather(store(spark, [("ab cd", 0.0, 1.0)], [("ab", 0.0, 1.0)])))
    assert values(rows, "s", "d", "i") == [(0, 1, 0)]
    native = metrics.label_error_rate(seqalign.gather(store(spark, [("ab cd", 0.0, 1.0)], [("ab", 0.0, 1.0)])))
    assert values(native, "n_ref", "edits") == [(1, 1)]


def test_identical_sides(spark):
    seq = [("a", 0.0, 0.1), ("b", 0.1, 0.3)]
    row = metrics.report(metrics.score(store(spark, seq, seq))).filter("level = 'global'").first()
    assert (row["per_pct"], row["f1_20ms_pct"], row["aas_ms"], row["k"]) == (0.0, 100.0, 0.0, 2)


def test_nothing_matched(spark):
    rows = metrics.report(metrics.score(store(spark, [("a", 0.0, 0.1)], [("b", 5.0, 5.1)]))).collect()
    assert {r["level"] for r in rows} == {"file", "style", "global"}
    for r in rows:
        assert r["k"] is None and r["aas_ms"] is None and r["p90_ms"] is None
        assert (r["per_pct"], r["p_20ms_pct"], r["f1_20ms_pct"]) == (100.0, 0.0, 0.0)


def test_cap(spark):
    ref, hyp = [("a", 1.0, 2.0)], [("a", 1.125, 2.25)]
    s = metrics.score(store(spark, ref, hyp))
    row = metrics.report(s).filter("level = 'file'").first()
    assert (row["aas_ms"], row["pct_gt_100ms"], row["median_be_ms"]) == (125.0, 100.0, 125.0)
    free = metrics.score(store(spark, ref, hyp), metrics.ScoreOptions(cap_ms=0))
    assert metrics.report(free).filter("level = 'file'").first()["aas_ms"] == 187.5


def test_group_called_like_the_overall_row(spark):
    seq = [("a", 0.0, 0.1)]
    rows = metrics.report(metrics.score(store(spark, seq, seq, style="ALL")))
    assert values(rows, "level", "group", "style") == [("file", "u", "ALL"), ("global", "GLOBAL", "ALL"), ("style", "STYLE_ALL", "ALL")]


def test_tolerance_tags():
    assert tolerance_tags([0.02, 0.0205, 0.05]) == {"20": 0.0205, "50": 0.05}


def test_boundary_counts(spark):
    ref = [("a", 0.0, 0.01), ("a", 0.01, 0.01)]
    c = with_boundary_counts(seqalign.gather(store(spark, ref, [("x", 0.005, 0.005)])), [0.02])
    assert values(c, "b_ref", "b_hyp", "tp_20", "fp_20", "fn_20") == [(2, 1, 1, 0, 1)]


def test_quantiles_by_digits_equal_the_builtin(spark):
    df = spark.range(4000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "pow(id % 911, 1.5) AS v", "1 AS n")
    wanted = {"med": (F.col("n"), 0.5), "p90": (F.col("n"), 0.9), "cap": (F.when(F.col("v") <= 900, F.col("n")).otherwise(0), 0.5)}
    rounded = [F.round(c, 9) for c in ("med", "p90", "cap")]
    a = quantiles.exact_quantiles(df, ["g"], "v", wanted)
    counted = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    for rows, digit in ((df, 16), (counted, 16), (df, 7)):
        b = quantiles.exact_quantiles(rows, ["g"], "v", wanted, max_in_task=10, digit=digit)
        assert values(a.select("g", *rounded), "*") == values(b.select("g", *rounded), "*")


def test_quantiles_by_digits_on_odd_values(spark):
    odd = {
        "signs": [-3.5, -1e-300, -0.0, 0.0, 1e-300, 2.0, 1e308],
        "ties": [7.25] * 9 + [7.25000000000001],
        "one": [-4.0],
        "none": [None, None],
        None: [1.0, 2.0, 4.0, None],
    }
    rows = [(g, v, 0 if g == "one" else 1) for g, vs in odd.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    wanted = {"low": (F.lit(1), 0.0), "med": (F.lit(1), 0.5), "p90": (F.lit(2), 0.9), "some": (F.col("n"), 0.5)}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", wanted, max_in_task=0, digit=16).collect()}
    assert set(got) == set(odd)
    for g, vs in odd.items():
        have = [v for v in vs if v is not None]
        weighted = {"low": (have, 0.0), "med": (have, 0.5), "p90": (sorted(have * 2), 0.9), "some": ([] if g == "one" else have, 0.5)}
        for name, (x, p) in weighted.items():
            if x:
                assert got[g][name] == pytest.approx(float(np.quantile(x, p)), rel=1e-12), (g, name)
            else:
                assert got[g][name] is None
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", wanted, max_in_task=-1).count() == 0


def test_ranks_by_histogram_shuffle_buckets_not_values(spark):
    """Ten times the values, the same rows in the histogram of a digit."""
    def buckets(n):
        df = spark.range(n).selectExpr("'g' AS g", "cast(id % 1000 + 1 + id / 1e7 AS double) AS v", "1L AS w_x")
        return quantiles._histogram(quantiles._with_bits(df, "v"), ["g"], "v", {"x": 0.5}, 0, 16).count()

    assert buckets(20_000) == buckets(200_000) < 300


def test_report_by_digits_equals_the_report(spark, monkeypatch):
    both = fx.one_side(spark, "/root/testdata/sf0.001", "ref").withColumn("side", F.lit("ref")).unionByName(
        fx.one_side(spark, "/root/testdata/sf0.001", "hyp").withColumn("side", F.lit("hyp"))
    )
    scored = metrics.score(both)

    def rows(df):
        number = [c for c, t in df.dtypes if t == "double"]
        return values(df.select(*[F.round(c, 6).alias(c) if c in number else F.col(f"`{c}`") for c in df.columns]), "*")

    plain = rows(metrics.report(scored)), rows(metrics.per_phoneme(scored))
    monkeypatch.setattr(metrics, "MAX_IN_TASK", 0)
    monkeypatch.setattr(metrics, "exact_quantiles", functools.partial(quantiles.exact_quantiles, max_in_task=0))
    assert plain == (rows(metrics.report(scored)), rows(metrics.per_phoneme(scored)))


def test_every_preset_code_against_literals(spark):
    from segmark.suite.labels import _CODES

    for preset in sorted({p for p, *_ in _CODES}):
        codes = [(c, v) for p, _, c, v in _CODES if p == preset]
        assert list(zip([c for c, _ in codes], normal(spark, L.build_rules(preset), [c for c, _ in codes]))) == codes


def test_shift_by_recording(spark):
    rows = spark.range(60).selectExpr("IF(id < 50, 'hot', concat('u', id % 3)) AS utt", "id AS pos", "id * 1D AS start_s", "id + 1D AS end_s")
    offsets = spark.createDataFrame([("hot", 2.0), ("u0", -1.0), ("u1", None), ("else", 9.0)], "utt string, offset_s double")
    want = sorted(((r.utt, r.pos, None if r.utt == "u1" else r.start_s - {"hot": 2, "u0": -1}[r.utt]) for r in rows.collect() if r.utt != "u2"), key=repr)
    for limit in (8, 1000):
        assert values(iv.shift_by_recording(rows, offsets, limit), "utt", "pos", "start_s") == want


# ---- scans --------------------------------------------------------------------------------------


def test_blocked_scans_equal_plain_windows(spark):
    df = spark.range(300).selectExpr(
        "IF(id < 200, 'hot', concat('k', id % 4)) AS k", "id", "IF(id % 5 = 0, id, NULL) AS e", "id % 3 AS x"
    )
    df = scan.with_rank(df, ["k"], ["id"], 1, "pos", limit=1 << 20)
    again = scan.with_rank(df.drop("pos"), ["k"], ["id"], 1 << 40, "pos")
    assert values(df, "k", "id", "pos") == values(again, "k", "id", "pos")
    for width in (7, None):
        block = scan.position_block("pos", width)
        out = scan.with_running_sum(df, ["k"], ["pos"], block, {"total": F.col("x")})
        out = scan.with_last_known(out, ["k"], ["pos"], block, {"known": F.col("e")})
        out = scan.with_previous(out, ["k"], "pos", {"prev": "x"}, width)
        out = scan.with_next(out, ["k"], "pos", {"next": "x"}, width)
        got = values(out, "k", "pos", "total", "known", "prev", "next")
        if width:
            blocked = got
    assert blocked == got


# ---- frames and activity ------------------------------------------------------------------------


def tokens(spark, seq):
    return spark.createDataFrame([("u", 0, k, t) for k, t in enumerate(seq)], "utt string, chunk int, frame int, token int")


def test_collapse_and_runs(spark):
    t = tokens(spark, [5, 5, 0, 5, 7])
    assert [r["token"] for r in fr.greedy_collapse(t).orderBy("frame").collect()] == [5, 5, 7]
    assert values(fr.token_runs(t), "token", "start_f", "end_f") == [(5, 0, 2), (5, 3, 4), (7, 4, 5)]
    assert values(fr.token_runs(t, width=2), "token", "start_f", "end_f") == [(5, 0, 2), (5, 3, 4), (7, 4, 5)]


def test_marks_join_the_interval_before(spark):
    vocab = spark.createDataFrame([(0, "[PAD]"), (1, "ɑ"), (2, "̃"), (3, "|"), (4, "[UNK]"), (5, "t")], "id int, token string")
    clock = spark.createDataFrame([("u", 0, 10.0, 0.02, 9)], "utt string, chunk int, offset_s double, frame_s double, n_frames long")
    runs = fr.token_runs(tokens(spark, [2, 1, 2, 2, 3, 4, 5, 0, 0]))
    span = fr.runs_to_intervals(runs, vocab, clock, fr.ctc_options("wav2vec2", unk_id=4))
    assert values(span, "phoneme", "start_s", "end_s") == [("t", 10 + 6 * 0.02, 10 + 7 * 0.02), ("ɑ̃", 10 + 1 * 0.02, 10 + 4 * 0.02)]
    tight = fr.runs_to_intervals(runs, vocab, clock, fr.ctc_options("greedy", unk_id=4))
    assert values(tight, "phoneme", "start_s", "end_s") == [("t", 10 + 6 * 0.02, 10 + 9 * 0.02), ("ɑ̃", 10 + 1 * 0.02, 10 + 6 * 0.02)]
    text_ = fr.join_tokens(fr.greedy_collapse(tokens(spark, [2, 1, 2, 5])), vocab)
    assert values(text_, "phonemes") == [("̃ ɑ̃ t",)]


def plain_viterbi(log_probs, targets, blank):
    """All states of all frames kept: staying before advancing before skipping."""
    states = [blank]
    for t in targets:
        states += [t, blank]
    best = [{s: log_probs[0][states[s]] for s in (0, 1) if s < len(states)}]
    back = [{}]
    for row in log_probs[1:]:
        here, moves = {}, {}
        for s in range(len(states)):
            options = [s, s - 1] + ([s - 2] if s > 2 and states[s] != blank and states[s] != states[s - 2] else [])
            options = [(best[-1][o], -n, o) for n, o in enumerate(options) if o in best[-1]]
            if options:
                score, _, moves[s] = max(options)
                here[s] = score + row[states[s]]
        best.append(here)
        back.append(moves)
    ends = [s for s in (len(states) - 1, len(states) - 2) if s in best[-1]]
    if not ends:
        return None
    at = max(ends, key=lambda s: (best[-1][s], s))
    path = []
    for t in reversed(range(len(log_probs))):
        path.append(states[at])
        at = back[t].get(at, at)
    return path[::-1]


def test_viterbi_in_strips_is_that_of_all_states():
    rng = np.random.default_rng(5)
    chunks, targets = [], []
    for _ in range(150):
        n, classes = int(rng.integers(1, 40)), int(rng.integers(2, 6))
        # Few distinct values make many ties.
        chunks.append(np.round(rng.random((n, classes)) * 3) - 4.0)
        targets.append(rng.integers(1, classes, int(rng.integers(0, 12))))
    together = fr.viterbi_many(chunks, targets, 0)
    for p, t, got in zip(chunks, targets, together):
        want = plain_viterbi(p.tolist(), t.tolist(), 0)
        alone = fr.viterbi(p, t, 0)
        assert (got is None) == (want is None) == (alone is None)
        assert want is None or got.tolist() == want == alone.tolist()


def test_viterbi_of_a_long_chunk_keeps_few_rows():
    rng = np.random.default_rng(6)
    n, labels = 20_000, 500
    targets = rng.integers(1, 20, labels)
    probs = rng.random((n, 20))
    tracemalloc.start()
    path = fr.viterbi(probs, targets, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * n * 20 * 8  # all moves alone would take 20 MB, all scores 160 MB
    collapsed = [x for k, x in enumerate(path.tolist()) if x and (not k or path[k - 1] != x)]
    assert collapsed == targets.tolist()


@pytest.mark.parametrize("cube", [1 << 22, 60])
def test_forced_alignment_streams_chunks(spark, monkeypatch, cube):
    """Many chunks, some without frames or targets, repeated targets: as chunk by chunk; no cogroup in the plan."""
    monkeypatch.setattr(fr, "CUBE", cube)
    rng = np.random.default_rng(7)
    frames, targets, want = [], [], []
    for k in range(40):
        utt, chunk = f"u{k % 5}", k // 5
        logits, own = rng.random((int(rng.integers(1, 30)), 4)) * 4, rng.integers(1, 4, int(rng.integers(0, 8)))
        if k % 9 != 8:
            frames += [(utt, chunk, f, [float(x) for x in row]) for f, row in enumerate(logits)]
        if k % 7 != 6:
            targets += [(utt, chunk, own.tolist())] * (1 + (k % 4 == 3))
        if k % 9 != 8 and k % 7 != 6:
            path = fr.viterbi(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), own, 0)
            want += [(utt, chunk, None, None)] if path is None else [(utt, chunk, f, int(t)) for f, t in enumerate(path)]
    rng.shuffle(frames_ := np.arange(len(frames)))
    df = spark.createDataFrame([frames[i] for i in frames_], "utt string, chunk int, frame int, logits array<double>")
    out = fr.forced_align(df, spark.createDataFrame(targets, "utt string, chunk int, targets array<int>"))
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert "CoGroup" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("width", [1, 3, 10, 1 << 20])
def test_token_strings_in_blocks(spark, width):
    vocab = spark.createDataFrame([(0, "<pad>"), (1, "a"), (2, "b"), (3, "\u0303"), (4, "|")], "id int, token string")
    seqs = {"u": [3, 1, 2, 3, 1, 1, 3, 3, 2], "v": [1], "w": [2, 3] * 12}
    rows = [(u, 0, f, t) for u, seq in seqs.items() for f, t in enumerate(seq)]
    own = spark.createDataFrame(rows, "utt string, chunk int, frame int, token int")
    got = {r.utt: r.phonemes for r in fr.join_tokens(own, vocab, width=width).collect()}
    assert got == {r.utt: r.phonemes for r in fr.join_tokens(own, vocab).collect()}
    assert got["w"] == " ".join(["b\u0303"] * 12) and got["v"] == "a" and got["u"].endswith("a a\u0303\u0303 b")


def test_whole_file_chunks_in_blocks(spark, monkeypatch):
    """One chunk a recording and a lowered bound: the same intervals and strings as in one window."""
    posteriors = fx.frames(spark, "/root/testdata/sf0.001").withColumns({"frame": F.col("chunk") * 25 + F.col("frame"), "chunk": F.lit(0)}).cache()
    lengths = posteriors.groupBy("utt").agg(((F.max("frame") + 1) * 0.02).alias("duration_s"))
    run = lambda: fr.ctc_align(posteriors, fr.whole_file_chunks(lengths), lengths, fx.frame_vocab(spark), fr.ctc_options("greedy", unk_id=3))
    whole = [Counter(map(tuple, x.collect())) for x in run()]
    monkeypatch.setattr(fr, "BLOCK_ROWS", 10)
    assert [Counter(map(tuple, x.collect())) for x in run()] == whole and whole[0]


def test_forced_alignment_too_short(spark):
    frames = spark.createDataFrame([("u", 0, 0, [0.1, 0.9, 0.0])], "utt string, chunk int, frame int, logits array<float>")
    targets = spark.createDataFrame([("u", 0, [1, 2])], "utt string, chunk int, targets array<int>")
    assert values(fr.forced_align(frames, targets), "frame", "token") == [(None, None)]


def test_window_starts_add_up(spark):
    d = spark.createDataFrame([("u", 1.0), ("v", 0.0)], "utt string, duration_s double")
    got = values(fr.fixed_chunks(d, 0.3), "chunk", "start_s", "end_s")
    starts = [0.0, 0.3, 0.3 + 0.3, 0.3 + 0.3 + 0.3]
    assert got == [(k, s, min(s + 0.3, 1.0)) for k, s in enumerate(starts)]


def scores(spark, seq, utt="u"):
    return spark.createDataFrame([(utt, k, k / 10, float(x)) for k, x in enumerate(seq)], "utt string, frame int, t double, score double")


def test_vad_open_tail(spark):
    assert values(vad.binarize(scores(spark, [0.4, 0.6, 0.4, 0.3])), "start_s", "end_s") == [(0.1, 0.3)]
    assert values(vad.binarize(scores(spark, [0.6, 0.6])), "start_s", "end_s") == [(0.0, 0.1)]
    # An offset above the onset: a score between them ends speech and begins it.
    assert values(vad.binarize(scores(spark, [0.6, 0.6, 0.6, 0.1]), 0.5, 0.7), "start_s", "end_s") == [(0.0, 0.1), (0.2, 0.3)]


def test_vad_blocks_do_not_change_the_result(spark):
    # A long talk (one open segment), a choppy one, and silence in between.
    seq = [0.9 if (k * 37) % 11 > 2 or k < 400 else 0.1 for k in range(1500)]
    seq = [min(s, 0.5 + ((k * 7919) % 97) / 200) if s > 0.5 else s for k, s in enumerate(seq)]
    df = scores(spark, seq).unionByName(scores(spark, seq[700:], "v"))
    whole = vad.vad_chunks(df, 2.0, 0.5, 0.363)
    blocked = vad.vad_chunks(df, 2.0, 0.5, 0.363, block_seconds=8.0)
    assert values(whole, "utt", "chunk", "start_s", "end_s") == values(blocked, "utt", "chunk", "start_s", "end_s")
    assert whole.filter("end_s - start_s > 2.0000001").isEmpty()


# ---- intervals ----------------------------------------------------------------------------------


def test_offset_modes(spark):
    rows = spark.createDataFrame([("u", 0, "a", 5.0, 6.0), ("u", 1, "b", 6.0, 7.0)], "utt string, pos long, phoneme string, start_s double, end_s double")
    d = spark.createDataFrame([("u", 6.5)], "utt string, duration_s double")
    assert values(iv.correct_offset(rows, d, "auto"), "start_s") == [(5.0,), (6.0,)]
    assert values(iv.correct_offset(rows, d, "auto", tolerance=0.4), "start_s") == [(0.0,), (1.0,)]
    assert values(iv.correct_offset(rows, d, "force"), "start_s") == [(0.0,), (1.0,)]
    assert values(iv.correct_offset(rows, d, "never"), "start_s") == [(5.0,), (6.0,)]


def test_list_forms_have_one_row_per_recording(spark):
    rows = spark.createDataFrame([("u", k, x, float(k), k + 1.0) for k, x in enumerate("abcde")], "utt string, pos long, phoneme string, start_s double, end_s double")
    assert values(iv.phoneme_strings(rows), "utt", "phonemes") == [("u", "a b c d e")]
    (only,) = iv.interval_arrays(rows).collect()
    assert only["phones"] == list("abcde") and tuple(only["tuples"][3]) == (3.0, 4.0, "d")


def test_word_rule_is_the_same_everywhere(spark):
    labels = ["a", "a\u00a0b", "a\tb", "a \tb", " a", "a  b c", "\u2003\u2003x", "", "\x1c\x1cq r"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select(text.words(F.col("x")).alias("w")).collect()
    assert [r["w"] for r in got] == [text.words_of(x) for x in labels]
    assert text.words_of("a\u00a0b") == ["a\u00a0b"] and text.words_of("a \tb") == ["a", "b"] and text.words_of("a b") == ["a", "b"]


def test_edit_counts_below_and_above_the_length_bound(spark):
    sides = {"ref": ["a\u00a0b", "c  d", "e\tf", "g", "h i"], "hyp": ["a", "c", "d", "e\tf", "h", "i", "k"]}
    rows = [("u", "u.wav", "s", side, k, x, float(k), k + 1.0) for side, xs in sides.items() for k, x in enumerate(xs)]
    store = spark.createDataFrame(rows, "utt string, file string, style string, side string, pos long, phoneme string, start_s double, end_s double")
    counts = [metrics.score(store, metrics.ScoreOptions(max_one_task=n)).files.select("s", "d", "i").first() for n in (100, 2)]
    assert counts[0] == counts[1]
    rates = [anylength.label_error_rate(store, limit=n).select("edits").first()[0] for n in (100, 2)]
    assert rates == [sum(counts[0])] * 2


def test_own_aligner_gets_long_recordings_too(spark):
    @F.udf(seqalign.ALIGNED)
    def nothing_matches(ref, hyp):
        return [(k, None) for k in range(len(ref))], 0, len(ref), 0

    rows = [("u", "u.wav", "s", side, k, "a", float(k), k + 1.0) for side in ("ref", "hyp") for k in range(6)]
    store = spark.createDataFrame(rows, "utt string, file string, style string, side string, pos long, phoneme string, start_s double, end_s double")
    for limit in (100, 2):
        scored = metrics.score(store, metrics.ScoreOptions(max_one_task=limit), aligner=nothing_matches)
        assert tuple(scored.files.select("s", "d", "i").first()) == (0, 6, 0)
        assert anylength.matched_times(store, limit=limit, aligner=nothing_matches).count() == 0


@pytest.mark.parametrize("width", [None, 3, 2, 1])
def test_neighbours_over_gaps(spark, width):
    rows = spark.createDataFrame([("u", p, p * 10) for p in (0, 1, 3, 4, 9, 11)] + [("v", 7, 70)], "utt string, pos long, x int")
    before = scan.with_previous(rows, ["utt"], "pos", {"b": "x"}, width)
    after = scan.with_next(rows, ["utt"], "pos", {"n": "x"}, width)
    joined = before.join(after.select("utt", "pos", "n"), ["utt", "pos"]).orderBy("utt", "pos").select("b", "n").collect()
    assert [tuple(r) for r in joined] == [(None, 10), (0, 30), (10, 40), (30, 90), (40, 110), (90, None), (None, None)]


def test_alignment_kernel_runs_once(spark):
    rows = [("u", "u.wav", "s", side, k, "a", float(k), k + 1.0) for side in ("ref", "hyp") for k in range(3)]
    store = spark.createDataFrame(rows, "utt string, file string, style string, side string, pos long, phoneme string, start_s double, end_s double")
    for out in (anylength.pair_rows(store, longest=3), anylength.matched_times(store, longest=3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def own_run(spark, rule=None, aligner=None, n=40):
    """An evaluation of ``n`` recordings of three labels each, u7 with a label of its own."""
    rows = [(f"u{k}", p, "bad" if k == 7 and p == 1 else "abc"[p], float(p), p + 1.0) for k in range(n) for p in range(3)]
    raw = spark.createDataFrame(rows, "utt string, pos long, label string, start_s double, end_s double")
    samples = raw.select("utt", F.concat("utt", F.lit(".wav")).alias("file"), F.lit("ALL").alias("style")).distinct()
    options = evaluation.EvaluationOptions(**({"ref_rules": rule, "hyp_rules": rule} if rule else {}))
    return evaluation.evaluate_tables(samples, raw, raw, None, options, **({"aligner": aligner} if aligner else {}))


SMALL_VOCABULARY = lab._small_vocabulary


def raising_rules():
    def by_row(x):
        if x == "bad":
            raise KeyError("no such label")
        return x

    def by_series(x: pd.Series) -> pd.Series:
        return x.map(by_row)

    def by_array(x: pa.Array) -> pa.Array:
        return pa.array([by_row(v) for v in x.to_pylist()], pa.string())

    return [F.udf(by_row, "string"), F.pandas_udf(by_series, "string"), F.arrow_udf(by_array, "string")]


@pytest.mark.parametrize("kind", range(3))
def test_a_rule_that_raises_fails_one_recording(spark, kind, monkeypatch):
    rule = L.CustomRules(raising_rules()[kind])
    for most in (lab.MAX_VOCABULARY, 0):  # over the vocabulary, and on the rows in place
        monkeypatch.setattr(lab, "_small_vocabulary", (lambda f: lambda df, c, _: f(df, c, most))(SMALL_VOCABULARY))
        result = own_run(spark, rule)
        assert values(result.failures, "utt", "reason") == [("u7", "KeyError: 'no such label'")]
        assert result.scored.files.count() == 39 and result.store.filter("utt = 'u7'").isEmpty()
    with pytest.raises(Exception, match="no such label"):  # outside a run, nobody looks at the errors
        lab.normalize_labels(spark.createDataFrame([("bad",)], "label string"), "label", rule).collect()


@pytest.mark.parametrize("kind", range(2))
def test_an_aligner_that_raises_fails_one_recording(spark, kind):
    def by_row(ref, hyp):
        if "bad" in ref:
            raise RuntimeError("cannot align this")
        return [(k, k) for k in range(len(ref))], 0, 0, 0

    aligned = to_arrow_type(seqalign.ALIGNED)

    def by_array(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        rows = [by_row(r, h) for r, h in zip(ref.to_pylist(), hyp.to_pylist())]
        return pa.array([{"pairs": [{"ref_idx": a, "hyp_idx": b} for a, b in r[0]], "s": 0, "d": 0, "i": 0} for r in rows], aligned)

    aligner = [F.udf(by_row, seqalign.ALIGNED), F.arrow_udf(by_array, seqalign.ALIGNED)][kind]
    result = own_run(spark, aligner=aligner)
    assert values(result.failures, "utt", "reason") == [("u7", "RuntimeError: cannot align this")]
    assert result.scored.files.count() == 39 and result.store.select("utt").distinct().count() == 39
    assert result.report.filter("level = 'global'").count() == 1


def test_a_batch_is_halved_to_the_rows_at_fault():
    calls = []

    def run(x):
        calls.append(len(x))
        if any(v % 100 == 0 for v in x.to_pylist()):
            raise ValueError("hundreds")
        return x

    parts, errors = guarded.outcome(run, pa.int64(), [pa.array(range(1, 1001))])
    found = pa.concat_arrays(parts).to_pylist()
    assert [v for v in found if v is not None] == [v for v in range(1, 1001) if v % 100]
    assert [k + 1 for k, e in enumerate(errors) if e] == list(range(100, 1001, 100)) and set(filter(None, errors)) == {"ValueError: hundreds"}
    assert len(calls) < 250


def test_own_label_function_and_aligner(spark):
    own = L.CustomRules(lambda c: F.when(c != "x", F.upper(c)))
    df = spark.createDataFrame([("a",), ("x",), (None,)], "label string")
    assert values(lab.normalize_labels(df, "label", own), "phoneme") == [("A",), (None,), (None,)]

    def diagonal(ref, hyp):
        n = F.least(F.size(ref), F.size(hyp))
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("ref_idx"), k.alias("hyp_idx")))
        zero = F.lit(0)
        return F.struct(pairs.alias("pairs"), zero.alias("s"), (F.size(ref) - n).alias("d"), (F.size(hyp) - n).alias("i"))

    both = store(spark, [("a", 0.0, 0.1), ("b", 0.1, 0.2)], [("b", 0.0, 0.1), ("b", 0.1, 0.2), ("c", 0.2, 0.3)])
    row = metrics.score(both, aligner=diagonal).files.first()
    assert (row["m_k"], row["d"], row["i"]) == (1.0, 0, 1)


@pytest.mark.parametrize("onset, offset", [(0.5, 0.363), (0.4, 0.7), (0.5, 0.5), (0.3, 0.9)])
@pytest.mark.parametrize("bound", [None, 4])
def test_hysteresis_either_way(spark, monkeypatch, onset, offset, bound):
    import random

    if bound:
        monkeypatch.setattr(vad, "BLOCK_ROWS", bound)
    rng = random.Random(int(onset * 100))
    rows, want = [], []
    for u in range(6):
        scores = [rng.random() for _ in range(30)]
        rows += [(f"u{u}", k, k * 0.1, x) for k, x in enumerate(scores)]
        on, start = scores[0] > onset, 0
        for k, x in enumerate(scores[1:], 1):
            if on and x < offset:
                want.append((f"u{u}", start, k))
                on = False
            elif not on and x > onset:
                on, start = True, k
        if on:
            want.append((f"u{u}", start, 29))
    frames = spark.createDataFrame(rows, "utt string, frame int, t double, score double")
    got = vad.binarize(frames, onset, offset)
    assert sorted((r["utt"], round(r["start_s"] * 10), round(r["end_s"] * 10)) for r in got.collect()) == sorted(want)


def test_pause_next_to_marks(spark):
    none = L.PRESETS["none"]
    assert normal(spark, none, ["ɑ̃pause", "pauseé x", "ɑ̃", "x_pause2 y"]) == ["ɑ̃", "x", "ɑ̃", "y"]


def test_cut_points_can_be_cleared(spark):
    import os

    from segmark import session

    rows = session.cut(spark.range(3).toDF("x"), "probe")
    (file, *_) = rows.inputFiles()
    assert rows.count() == 3 and os.path.exists(file.removeprefix("file://"))
    assert session.clear_cuts(spark) >= 1 and not os.path.exists(file.removeprefix("file://"))


def test_frequent_labels_of_a_large_vocabulary_are_met_by_broadcast(spark):
    rows = [("often",)] * 50 + [("[also] often",)] * 40 + [(f"rare{k}",) for k in range(30)] + [("sil",), (None,)]
    df = spark.createDataFrame(rows, "label string")
    vocabulary, complete = lab._small_vocabulary(df, "label", 10)
    assert not complete and values(vocabulary, "label") == [("[also] often",), ("often",)]
    assert lab._small_vocabulary(df, "label", 100)[1]
    expected = values(lab.normalize_labels(df, "label", L.PRESETS["none"]), "label", "phoneme")
    assert values(lab.normalize_labels(df, "label", L.PRESETS["none"], max_vocabulary=10), "label", "phoneme") == expected
    sides = df.withColumn("side", F.when(F.length("label") % 2 == 0, "ref").otherwise("hyp"))
    rules = {"ref": L.CustomRules(raising_rules()[1]), "hyp": L.PRESETS["none"]}
    sides = sides.unionByName(spark.createDataFrame([("bad", "ref"), ("bad", "hyp")], "label string, side string"))
    whole, parts = (values(lab.normalize_sides(sides, "label", "side", rules, max_vocabulary=n, error="why"), "side", "label", "phoneme", "why") for n in (100, 10))
    assert whole == parts and len(parts) == len(rows) + 2 and sum(r[3] is not None for r in parts) == 1


def test_a_value_at_fault_is_looked_for_once():
    calls = []

    def run(x):
        calls.append(len(x))
        if any(v.startswith("bad") for v in x.to_pylist()):
            raise ValueError("bad")
        return pa.array([v.upper() for v in x.to_pylist()])

    checked = guarded.by_value(run, pa.string())
    batch = [f"w{k % 100}" for k in range(1000)] + ["bad1", None, "bad1", "bad2"]
    for _ in range(3):
        got = checked(pa.array(batch)).to_pylist()
        assert [g and g["value"] for g in got] == [None if v is None or v.startswith("bad") else v.upper() for v in batch]
        assert [k for k, g in enumerate(got) if g and g["error"]] == [1000, 1002, 1003]
    assert max(calls) == 102 and len(calls) < 40  # one search among the distinct values, then a call a batch
    assert checked(pa.array([], pa.string())).to_pylist() == [] and checked(pa.array([None], pa.string())).to_pylist() == [None]


def test_recordings_go_to_the_kernels_in_small_batches(spark):
    aligned = to_arrow_type(seqalign.ALIGNED)

    def size(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        return pa.array([{"pairs": [{"ref_idx": 0, "hyp_idx": 0}], "s": 0, "d": 0, "i": len(ref)}] * len(ref), aligned)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.range(12_000).select(F.concat(F.lit("u"), "id").alias("utt"), F.lit("f").alias("file"), F.lit("ALL").alias("style"))
        sides = rows.select("*", F.explode(F.array(F.lit("ref"), F.lit("hyp"))).alias("side"), F.lit(0).alias("pos"), F.lit("a").alias("phoneme"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"))
        scored = metrics.score(sides, aligner=F.arrow_udf(size, seqalign.ALIGNED))
        assert scored.files.count() == 12_000 and scored.files.agg(F.max("i")).first()[0] == 1000
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
