"""From frame posteriors to intervals: best tokens, collapse, runs, forced paths, the frame clock."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from segmark.functions import text
from segmark.operators.large import join_facts
from segmark.operators.scan import (
    BLOCK_ROWS,
    position_block,
    with_next,
    with_previous,
    with_row_index,
    with_running_sum,
)
from segmark.session import cut

# Frame stride, skipped tokens, shortest chunk, sample rate.
FRAME_STRIDE_SAMPLES = 320
FRAME_STRIDE_S = 0.02
SKIP_TOKENS = ("", " ", "[", "|")
MIN_CHUNK_SAMPLES = 3200
SAMPLE_RATE = 16_000

CHUNK = ("utt", "chunk")


@dataclass(frozen=True)
class CtcOptions:
    """How posteriors of one model family become intervals."""

    blank_id: int = 0
    unk_id: int | None = None
    frame_stride_s: float | None = FRAME_STRIDE_S
    frame_stride_samples: int = FRAME_STRIDE_SAMPLES
    trim_padding_frames: bool = True
    min_samples: int = 0
    decoder: str = "forced_align"
    end_mode: str = "span"
    sample_rate: int = SAMPLE_RATE
    skip_tokens: Sequence[str] = SKIP_TOKENS

    def __post_init__(self) -> None:
        if self.decoder not in ("forced_align", "greedy"):
            raise ValueError(f"decoder must be 'forced_align' or 'greedy', got {self.decoder!r}")
        if self.end_mode not in ("span", "contiguous"):
            raise ValueError(f"end_mode must be 'span' or 'contiguous', got {self.end_mode!r}")


#: Options per model family.
CTC_PRESETS: dict[str, CtcOptions] = {
    "wav2vec2": CtcOptions(min_samples=MIN_CHUNK_SAMPLES),
    "wavlm": CtcOptions(frame_stride_s=None, trim_padding_frames=False),
    "whisper": CtcOptions(),
    "greedy": CtcOptions(decoder="greedy", end_mode="contiguous"),
}


def ctc_options(model: str, **changes) -> CtcOptions:
    return replace(CTC_PRESETS[model], **changes)


def best_tokens(frames: DataFrame) -> DataFrame:
    """Best class per frame, the first one on ties."""
    return frames.select(
        "utt",
        "chunk",
        "frame",
        (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("token"),
    )


def _changed(tokens: DataFrame, width: int | None) -> DataFrame:
    before = with_previous(tokens, CHUNK, "frame", {"prev": "token"}, width)
    changed = F.col("prev").isNull() | (F.col("prev") != F.col("token"))
    return before.withColumn("changed", changed.cast("int")).drop("prev")


def greedy_collapse(tokens: DataFrame, blank_id: int = 0, width: int | None = None) -> DataFrame:
    """Frames where a new non-blank token begins: repeats go first, then blanks."""
    return (
        _changed(tokens, width)
        .filter((F.col("changed") == 1) & (F.col("token") != blank_id))
        .drop("changed")
    )


def token_runs(tokens: DataFrame, blank_id: int = 0, width: int | None = None) -> DataFrame:
    """Runs of equal frames (utt, chunk, run, token, start_f, end_f); blank runs dropped, end exclusive."""
    marked = with_running_sum(
        _changed(tokens, width), CHUNK, ["frame"], position_block("frame", width), {"run": F.col("changed")}
    )
    return (
        marked.groupBy(*CHUNK, "run")
        .agg(
            F.min("token").alias("token"),
            F.min("frame").alias("start_f"),
            (F.max("frame") + 1).alias("end_f"),
        )
        .filter(F.col("token") != blank_id)
    )


def vocabulary(vocab: DataFrame) -> DataFrame:
    """Vocabulary (id, token) with flags: one combining mark; made of combining marks only."""
    c = vocab.withColumn("c", text.compose("token"))
    # Marks of the composed form suffice: composition never turns a lone mark into another character class.
    folds = text.only_marks(F.col("c.nfc"), F.col("c.marks"))
    return c.select("id", "token", (folds & (F.length("token") == 1)).alias("is_mark"), folds.alias("folds"))


def runs_to_intervals(
    runs: DataFrame,
    vocab: DataFrame,
    clock: DataFrame,
    options: CtcOptions,
    width: int | None = None,
) -> DataFrame:
    """Runs to intervals in seconds (utt, chunk, k, phoneme, start_s, end_s), ``k`` dense per chunk.

    A lone combining mark joins the interval before it (and, with span ends, stretches it). ``clock``
    holds offset_s, frame_s and n_frames per chunk. With contiguous ends an interval lasts until the
    next one, the last until the end of its chunk.
    """
    words = F.broadcast(vocabulary(vocab))  # one row per class of the model
    decoded = runs.join(words, runs["token"] == words["id"], "inner").select(
        *CHUNK, "run", "start_f", "end_f", words["token"].alias("label"), F.col("is_mark"),
        (runs["token"] == F.lit(options.unk_id)).alias("unk"),
    )
    kept = decoded.filter(
        ~F.coalesce(F.col("unk"), F.lit(False)) & ~F.col("label").isin(*options.skip_tokens)
    )
    numbered = with_running_sum(
        kept, CHUNK, ["run"], position_block("run", width), {"k": (~F.col("is_mark")).cast("int")}
    ).filter(F.col("k") > 0)
    spoken = F.transform(F.sort_array(F.collect_list(F.struct("run", "label"))), lambda x: x["label"])
    base = (
        numbered.groupBy(*CHUNK, "k")
        .agg(
            F.array_join(spoken, "").alias("phoneme"),
            F.min("start_f").alias("start_f"),
            F.max("end_f").alias("end_f"),
        )
        .withColumn("k", F.col("k") - 1)
    )
    # With a width there are long chunks; their rows of the clock go to the intervals by broadcast.
    base = join_facts(base, clock, F.col("n_frames") > (width or 0), 1 if width else 0, 0, CHUNK)
    offset, step = F.col("offset_s"), F.col("frame_s")
    timed = base.withColumn("start_s", offset + F.col("start_f") * step)
    if options.end_mode == "contiguous":
        timed = with_next(timed, CHUNK, "k", {"next_s": "start_s"}, width)
        end = F.coalesce(F.col("next_s"), offset + F.col("n_frames") * step)
    else:
        end = offset + F.col("end_f") * step
    return timed.select(*CHUNK, "k", "phoneme", "start_s", end.alias("end_s"))


def frame_clock(
    chunks: DataFrame, durations: DataFrame, frame_counts: DataFrame, options: CtcOptions
) -> DataFrame:
    """Per chunk: sample range, real samples, padded length, kept frames, offset and frame duration.

    Chunks holding no sample of the recording are left out.
    """
    sr = options.sample_rate
    total = F.floor(F.col("duration_s") * sr + 0.5).cast("long")
    first = F.floor(F.col("start_s") * sr).cast("long")
    last = F.floor(F.col("end_s") * sr).cast("long")
    real = F.greatest(F.least(F.col("end_sample"), F.col("n_samples")) - F.col("start_sample"), F.lit(0))
    c = (
        chunks.join(durations, "utt")
        .select(
            *CHUNK, first.alias("start_sample"), last.alias("end_sample"), total.alias("n_samples")
        )
        .withColumn("real_samples", real)
        .filter(F.col("real_samples") > 0)
        .join(frame_counts, list(CHUNK))
    )
    valid = F.greatest(F.lit(1), F.ceil(F.col("real_samples") / options.frame_stride_samples))
    if options.trim_padding_frames and options.frame_stride_samples:
        kept = F.least(F.col("total_frames"), valid)
    else:
        kept = F.col("total_frames")
    c = c.withColumn("n_frames", kept.cast("long"))
    if options.frame_stride_s is not None:
        step = F.lit(float(options.frame_stride_s))
    else:
        step = (F.col("end_sample") - F.col("start_sample")).cast("double") / sr / F.col("n_frames")
    return c.select(
        *CHUNK,
        "start_sample",
        "end_sample",
        "real_samples",
        F.greatest("real_samples", F.lit(options.min_samples)).alias("padded_samples"),
        "n_frames",
        (F.col("start_sample").cast("double") / sr).alias("offset_s"),
        step.alias("frame_s"),
    )


def join_tokens(tokens: DataFrame, vocab: DataFrame, order: str = "frame", width: int = BLOCK_ROWS) -> DataFrame:
    """Per chunk, token texts joined by blanks; a token of combining marks is glued to the one before.

    Texts are put together in blocks of ``width`` positions first, so no task lists all tokens of a chunk.
    """
    words = F.broadcast(vocabulary(vocab))
    named = tokens.join(words, tokens["token"] == words["id"], "inner").select(
        *CHUNK,
        order,
        F.floor(F.col(order) / width).cast("long").alias("block"),
        # A blank in front of the first token goes with the strip at the end.
        F.when(F.col("folds"), words["token"]).otherwise(F.concat(F.lit(" "), words["token"])).alias("label"),
    )
    blocks = named.groupBy(*CHUNK, "block").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct(order, "label")))["label"], "").alias("label")
    )
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("block", "label")))["label"], "")
    return blocks.groupBy(*CHUNK).agg(text.strip(whole).alias("phonemes"))


def _steps(score: np.ndarray, may_skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score before each state and the move that gives it: 0 stays, 1 advances, 2 skips a blank."""
    best, move = score.copy(), np.zeros(score.shape, np.uint8)
    for k in (1, 2):
        other = np.full_like(score, -np.inf)
        other[:, k:] = score[:, :-k]
        if k == 2:
            other[~may_skip] = -np.inf
        better = other > best
        best[better], move[better] = other[better], k
    return best, move


def viterbi_many(log_probs: list[np.ndarray], targets: list[np.ndarray], blank: int) -> list[np.ndarray | None]:
    """For each chunk, the best frame labelling that collapses to its targets; None when there are too few frames.

    Equal scores prefer staying, then advancing by one state, then skipping a blank. All chunks take each frame
    together as one padded cube. Of the scores every k-th row is kept, k the root of the frames; the moves between two
    kept rows are worked out again on the way back, so memory is that of k rows, twice.
    """
    out: list[np.ndarray | None] = [None] * len(targets)
    enough = [
        k for k, (p, t) in enumerate(zip(log_probs, targets))
        if len(p) and len(p) >= len(t) + int((t[1:] == t[:-1]).sum())
    ]
    if not enough:
        return out
    count = len(enough)
    frames = np.array([len(log_probs[k]) for k in enough])
    width, height = 2 * max(len(targets[k]) for k in enough) + 1, int(frames.max())
    states, may_skip = np.full((count, width), blank), np.zeros((count, width), bool)
    cube = np.zeros((count, height, max(log_probs[k].shape[1] for k in enough)))
    ends = np.empty(count, np.int64)  # the last state of each chunk
    for b, k in enumerate(enough):
        own, n = targets[k], len(targets[k])
        states[b, 1 : 2 * n : 2] = own
        may_skip[b, 3 : 2 * n : 2] = own[1:] != own[:-1]
        cube[b, : frames[b], : log_probs[k].shape[1]] = log_probs[k]
        ends[b] = 2 * n
    every, stride = np.arange(count), max(1, int(height**0.5))

    def emitted(t: int) -> np.ndarray:
        return np.take_along_axis(cube[:, t], states, axis=1)

    score = np.full((count, width), -np.inf)
    score[:, :2] = emitted(0)[:, :2]
    kept, last = {0: score}, np.full((count, 2), -np.inf)  # scores of the last two states in a chunk's last frame
    for t in range(height):
        if t:
            score = _steps(score, may_skip)[0] + emitted(t)
            if t % stride == 0:
                kept[t] = score
        done = np.flatnonzero(frames == t + 1)
        last[done, 1] = score[done, ends[done]]
        labelled = done[ends[done] > 0]
        last[labelled, 0] = score[labelled, ends[labelled] - 1]
    at = ends - (last[:, 0] > last[:, 1])
    paths = np.zeros((count, height), np.int32)
    for base in reversed(range(0, height, stride)):
        stop = min(base + stride, height)
        score, moves = kept[base], [None]
        for t in range(base + 1, stop + (stop < height)):
            best, move = _steps(score, may_skip)
            moves.append(move)
            score = best + emitted(t)
        for t in reversed(range(base, stop)):
            alive = np.flatnonzero(frames > t)
            # The move into frame t + 1 tells the state in frame t.
            on = np.flatnonzero(frames > t + 1)
            if len(on):
                at[on] -= moves[t + 1 - base][on, at[on]]
            paths[alive, t] = states[alive, at[alive]]
        del kept[base]
    for b, k in enumerate(enough):
        out[k] = paths[b, : frames[b]]
    return out


def viterbi(log_probs: np.ndarray, targets: np.ndarray, blank: int) -> np.ndarray | None:
    """:func:`viterbi_many` of one chunk."""
    return viterbi_many([log_probs], [targets], blank)[0]


#: Values of the padded cube that chunks aligned together may take.
CUBE = 1 << 22
ALIGNED = "utt string, chunk int, frame int, token int"


def _aligned(rows: Iterator[pa.RecordBatch], blank: int) -> Iterator[pa.RecordBatch]:
    """Rows (utt, chunk, targets, frame, logits), a chunk's targets before its frames, as rows of ``ALIGNED``."""
    ready: list[tuple] = []

    def work() -> Iterator[pa.RecordBatch]:
        by = sorted(ready, key=lambda c: len(c[3]))
        at = 0
        while at < len(by):
            stop = at + 1
            while stop < len(by) and (stop + 1 - at) * len(by[stop][3]) * (by[stop][4].shape[1] + 2) <= CUBE:
                stop += 1
            own = by[at:stop]
            for (utt, chunk, _, frame, _), path in zip(own, viterbi_many([c[4] for c in own], [c[2] for c in own], blank)):
                if path is None:
                    frame, path = [None], [None]
                columns = [pa.array([utt] * len(frame), pa.string()), pa.array([chunk] * len(frame), pa.int32()), pa.array(frame, pa.int32()), pa.array(path, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["utt", "chunk", "frame", "token"])
            at = stop

    def close(open_: tuple | None) -> int:
        if open_ is None or open_[2] is None or not open_[3]:
            return 0  # frames or targets alone
        utt, chunk, targets, frames, logits = open_
        values = np.concatenate(logits)
        values -= values.max(axis=1, keepdims=True)
        values -= np.log(np.exp(values).sum(axis=1, keepdims=True))
        ready.append((utt, chunk, targets, np.concatenate(frames), values))
        return values.size

    open_, held = None, 0
    for b in rows:
        utt, chunk = b.column(0), b.column(1)
        codes = utt.dictionary_encode().indices.to_numpy()
        number = chunk.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (number[1:] != number[:-1])) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]) if b.num_rows else ():
            key = utt[first].as_py(), chunk[first].as_py()
            if open_ is None or open_[:2] != key:
                held += close(open_)
                if held > CUBE:
                    yield from work()
                    ready, held = [], 0
                open_ = (*key, None, [], [])
            if b.column(2)[first].is_valid:
                open_ = (*key, np.asarray(b.column(2)[first].values, np.int64), [], [])
                first += 1
                while first < last and b.column(2)[first].is_valid:
                    first += 1  # a repeated target counts once
            if first < last:
                logits = b.column(4).slice(first, last - first)
                open_[3].append(b.column(3).slice(first, last - first).to_numpy(zero_copy_only=False))
                open_[4].append(np.asarray(logits.flatten(), np.float64).reshape(last - first, -1))
    close(open_)
    yield from work()


def forced_align(frames: DataFrame, targets: DataFrame, blank_id: int = 0) -> DataFrame:
    """Frame labels (utt, chunk, frame, token) of the best path through given targets per chunk.

    ``targets`` is (utt, chunk, targets array<int>). Frames stream through a task in order, a chunk at a time; short
    chunks are aligned together. A task holds one chunk's log probabilities and some rows of scores, however long the
    chunk. A chunk too short for its targets yields one row with a NULL frame and token, one without frames or targets
    none. For the usual target, the greedy collapse of the same posteriors, use :func:`forced_greedy_path`.
    """
    own = frames.select("utt", F.col("chunk").cast("int").alias("chunk"), F.lit(None).cast("array<int>").alias("targets"), F.col("frame").cast("int").alias("frame"), F.col("logits").cast("array<double>").alias("logits"))
    wanted = targets.filter("targets is not null").select("utt", F.col("chunk").cast("int").alias("chunk"), F.col("targets").cast("array<int>").alias("targets"), F.lit(None).cast("int").alias("frame"), F.lit(None).cast("array<double>").alias("logits"))
    dealt = own.union(wanted).repartition(*CHUNK).sortWithinPartitions(*CHUNK, F.col("frame").asc_nulls_first())
    return dealt.mapInArrow(lambda rows: _aligned(rows, blank_id), ALIGNED)


def forced_greedy_path(frames: DataFrame) -> DataFrame:
    """Forced alignment of the greedy-collapsed sequence against its own posteriors, for any length.

    The best class per frame is itself a labelling that collapses to that target, and no labelling can
    score higher in any frame, so it is the forced path (ties: the first class). No Viterbi, no
    grouping.
    """
    return best_tokens(frames)


def ctc_align(
    frames: DataFrame,
    chunks: DataFrame,
    durations: DataFrame,
    vocab: DataFrame,
    options: CtcOptions,
) -> tuple[DataFrame, DataFrame]:
    """(intervals, label strings) of every recording from its posteriors, chunk by chunk.

    Both decoders emit the greedy-collapsed string. Intervals carry ``pos``, dense per recording in
    chunk order.
    """
    counts = frames.groupBy(*CHUNK).agg(F.count("*").alias("total_frames"))
    # One row per chunk, read by every branch below; it also tells how long the longest chunk is.
    clock = cut(frame_clock(chunks, durations, counts, options), "clock")
    longest = clock.agg(F.max("n_frames")).first()[0] or 0
    width = BLOCK_ROWS if longest > BLOCK_ROWS else None
    path = best_tokens if options.decoder == "greedy" else forced_greedy_path
    tokens = (
        join_facts(path(frames), clock.select(*CHUNK, "n_frames"), F.col("n_frames") > BLOCK_ROWS, longest, BLOCK_ROWS, CHUNK)
        .filter(F.col("frame") < F.col("n_frames"))
        .drop("n_frames")
    )
    intervals = runs_to_intervals(token_runs(tokens, options.blank_id, width), vocab, clock, options, width)
    parts = (
        clock.select(*CHUNK)
        .join(join_tokens(greedy_collapse(tokens, options.blank_id, width), vocab), list(CHUNK), "left")
        .groupBy("utt")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", F.coalesce("phonemes", F.lit("")).alias("p")))).alias("c"))
    )
    strings = parts.select("utt", text.strip(F.array_join(F.col("c")["p"], " ")).alias("phonemes"))
    per_recording = clock.groupBy("utt").agg(F.sum("n_frames").alias("n")).agg(F.max("n")).first()[0] or 0
    return number_intervals(intervals, per_recording > BLOCK_ROWS), strings


def number_intervals(intervals: DataFrame, long_recordings: bool = True) -> DataFrame:
    """Dense position per recording over (chunk, k); long recordings are numbered in blocks of a chunk."""
    block = F.col("chunk").cast("long") * F.lit(1 << 32) + F.floor(F.col("k") / BLOCK_ROWS) if long_recordings else None
    return with_row_index(intervals, ["utt"], ["chunk", "k"], block, "pos").select(
        "utt", "pos", "phoneme", "start_s", "end_s"
    )


def whole_file_chunks(durations: DataFrame) -> DataFrame:
    """One chunk per recording."""
    return durations.select(
        "utt", F.lit(0).alias("chunk"), F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")
    )


def fixed_chunks(durations: DataFrame, window_s: float = 30.0) -> DataFrame:
    """Windows of ``window_s`` seconds; the last one ends with the recording.

    A start is the window length added up, so both sides of a window edge are the same double.
    """
    w = F.lit(float(window_s))
    # Multiples of a short dyadic fraction are exact: there, k * w is w added k times.
    if float(window_s * 1024).is_integer():
        last = F.ceil(F.col("duration_s") / w).cast("int")
        starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * w)
    else:
        starts = window_starts(float(window_s))(F.col("duration_s"))
    return (
        durations.filter(F.col("duration_s") > 0)
        .select("utt", "duration_s", F.posexplode(starts).alias("chunk", "start_s"))
        .filter(F.col("start_s") < F.col("duration_s"))
        .select("utt", "chunk", "start_s", F.least(F.col("start_s") + w, "duration_s").alias("end_s"))
    )


def window_starts(window_s: float):
    """Vectorised function: duration -> window starts by repeated addition."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def starts(duration: pa.Array) -> pa.Array:
        return pa.array(
            [
                np.concatenate(([0.0], np.cumsum(np.full(int(d / window_s) + 1, window_s))))
                for d in duration.to_numpy(zero_copy_only=False)
            ],
            pa.list_(pa.float64()),
        )

    return starts
