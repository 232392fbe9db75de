"""Projections and per-recording aggregates over interval tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmark.operators.large import join_facts
from segmark.session import cut

#: Intervals of a recording that are joined by shuffle; longer ones are joined by broadcast.
LONG = 1 << 15


def interval_arrays(intervals: DataFrame) -> DataFrame:
    """Labels and (start, end, label) tuples as arrays in list order, one row per recording.

    A row is as long as its recording (a million labels are a few tens of MB); work that must not depend
    on that stays on the long table.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "start_s", "end_s", "phoneme")))
    return (
        intervals.groupBy("utt")
        .agg(ordered.alias("o"))
        .selectExpr(
            "utt",
            "o.phoneme AS phones",
            "transform(o, x -> struct(x.start_s, x.end_s, x.phoneme)) AS tuples",
        )
    )


def phoneme_sequence(intervals: Column) -> Column:
    """The labels of an interval array, index-aligned with it."""
    return intervals["phoneme"]


def phoneme_strings(intervals: DataFrame) -> DataFrame:
    """Labels joined by one blank (utt, phonemes), one row per recording of any length."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "phoneme")))
    return intervals.groupBy("utt").agg(F.array_join(ordered["phoneme"], " ").alias("phonemes"))


def shift_intervals(intervals: DataFrame, offset: Column) -> DataFrame:
    """Subtract an offset (seconds) from both times."""
    return intervals.withColumns({"start_s": F.col("start_s") - offset, "end_s": F.col("end_s") - offset})


def shift_by_recording(intervals: DataFrame, offsets: DataFrame, limit: int = LONG) -> DataFrame:
    """Subtract each recording's own offset (utt, offset_s) from both times.

    Recordings without an offset are left out. Those of more than ``limit`` intervals meet theirs by broadcast.
    """
    sizes = intervals.groupBy("utt").agg(F.count("*").alias("n"))
    facts, longest = _facts(sizes.join(offsets.select("utt", F.col("offset_s").alias("shift")), "utt"))
    moved = join_facts(intervals, facts, F.col("n") > limit, longest, limit)
    return shift_intervals(moved, F.col("shift")).select(*intervals.columns)


def correct_offset(
    intervals: DataFrame, durations: DataFrame, mode: str = "auto", tolerance: float = 0.5, limit: int = LONG
) -> DataFrame:
    """Re-anchor recordings whose annotation kept the clock of a longer session.

    The offset is the start of the first interval. ``auto`` shifts when the last interval ends more than
    ``tolerance`` seconds after the recording, ``force`` always, ``never`` leaves the rows alone.
    Recordings of unknown duration are left alone in ``auto``. Recordings of more than ``limit`` intervals
    meet their offset by broadcast.
    """
    if mode == "never":
        return intervals
    if mode not in ("auto", "force"):
        raise ValueError(f"mode must be auto, force or never, got {mode!r}")
    ends = intervals.groupBy("utt").agg(
        F.min_by("start_s", "pos").alias("first_s"), F.max_by("end_s", "pos").alias("last_s"), F.count("*").alias("n")
    )
    shift = F.col("first_s")
    if mode == "auto":
        ends = ends.join(durations.select("utt", "duration_s"), "utt", "left")
        shift = F.when(F.col("last_s") > F.col("duration_s") + tolerance, shift).otherwise(0.0)
    facts, longest = _facts(ends.select("utt", "n", shift.alias("shift")))
    moved = join_facts(intervals, facts, F.col("n") > limit, longest, limit)
    return shift_intervals(moved, F.col("shift")).select(*intervals.columns)


def _facts(per_recording: DataFrame) -> tuple[DataFrame, int]:
    """One row per recording, written once, and the most intervals ``n`` that one has."""
    facts = cut(per_recording, "facts")
    return facts, facts.agg(F.max("n")).first()[0] or 0


def total_duration(intervals: DataFrame) -> DataFrame:
    """Summed duration per recording, gaps excluded."""
    return intervals.groupBy("utt").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total_s"))


def etf_rows(intervals: DataFrame, limit: int = LONG) -> DataFrame:
    """Detection timeline: every segment of positive length against every label of its recording.

    ``decision`` is t when the segment carries the label, else f. Labels per recording are inventory
    sized; the segments are never paired with each other, and those of recordings of more than ``limit``
    intervals meet their labels by broadcast.
    """
    facts, longest = _facts(intervals.groupBy("utt").agg(F.count("*").alias("n"), F.collect_set("phoneme").alias("targets")))
    segments = intervals.select(
        "utt", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "phoneme"
    ).filter(F.col("duration_s") > 0)
    return join_facts(segments, facts, F.col("n") > limit, longest, limit).select(
        "utt", "start_s", "duration_s", "phoneme", F.explode("targets").alias("target")
    ).select(
        "utt",
        "start_s",
        "duration_s",
        "target",
        F.when(F.col("phoneme") == F.col("target"), "t").otherwise("f").alias("decision"),
    )
