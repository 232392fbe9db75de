"""Alignment and matching of a long interval store whose recordings may have any length.

Each function takes (utt, file, style, side, <order>, phoneme, start_s, end_s), scores recordings of
ordinary length as one row each and tiles the others. ``longest`` is the largest number of labels on one
side of a recording, counted unless the caller knows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.operators import boundaries, large, metrics, seqalign


def _split(store: DataFrame, limit: int, longest: int | None, aligner: seqalign.Aligner):
    # A caller's own aligner is never replaced by the tiled one: it gets long recordings whole.
    return large.split_by_length(store, limit, longest) if aligner is seqalign.align_labels else (store, None)


def pair_rows(
    store: DataFrame,
    order: str = "pos",
    longest: int | None = None,
    limit: int = seqalign.MAX_ONE_TASK,
    aligner: seqalign.Aligner = seqalign.align_labels,
) -> DataFrame:
    """Edit-path steps (utt, ref_idx, hyp_idx, ref_phoneme, hyp_phoneme, op)."""
    small, big = _split(store, limit, longest, aligner)
    out = seqalign.pair_rows(seqalign.align(seqalign.gather(small, order), aligner))
    if big is None:
        return out
    rows = large.long_rows(big, order)
    return out.unionByName(large.large_pair_rows(rows, large.tiled_pairs(rows.select("utt", "side", "pos", "phoneme"))))


def matched_times(
    store: DataFrame,
    order: str = "pos",
    longest: int | None = None,
    limit: int = seqalign.MAX_ONE_TASK,
    aligner: seqalign.Aligner = seqalign.align_labels,
) -> DataFrame:
    """Pairs with equal labels and their times (utt, style, ref_idx, hyp_idx, phoneme, rs, re, hs, he)."""
    small, big = _split(store, limit, longest, aligner)
    out = seqalign.matched_times(seqalign.align(seqalign.gather(small, order), aligner))
    if big is None:
        return out
    rows = large.long_rows(big, order)
    found = large.large_matches(rows, large.tiled_pairs(rows.select("utt", "side", "pos", "phoneme")))
    times = ["r.start_s AS rs", "r.end_s AS re", "h.start_s AS hs", "h.end_s AS he"]
    return out.unionByName(found.selectExpr("utt", "style", "ref_idx", "hyp_idx", "r.phoneme AS phoneme", *times))


def boundary_counts(
    store: DataFrame,
    tolerances: Sequence[float],
    order: str = "pos",
    longest: int | None = None,
    limit: int = seqalign.MAX_ONE_TASK,
) -> DataFrame:
    """(utt, style, b_ref, b_hyp, tp/fp/fn per tolerance tag)."""
    small, big = large.split_by_length(store, limit, longest)
    out = boundaries.with_boundary_counts(seqalign.gather(small, order), tolerances).drop("file", "ref", "hyp")
    if big is None:
        return out
    rows = large.long_rows(big, order)
    styles = rows.select("utt", "style").distinct()
    return out.unionByName(large.large_boundary_counts(rows, tolerances).join(styles, "utt"))


def label_error_rate(
    store: DataFrame, order: str = "pos", longest: int | None = None, limit: int = seqalign.MAX_ONE_TASK
) -> DataFrame:
    """(utt, style, n_ref, edits)."""
    small, big = large.split_by_length(store, limit, longest)
    out = metrics.label_error_rate(seqalign.gather(small, order))
    if big is None:
        return out
    rows = large.long_rows(big, order)
    sizes = rows.groupBy("utt", "style").agg(F.count_if(F.col("side") == "ref").cast("int").alias("n_ref"))
    edits = large.large_edit_counts(rows).selectExpr("utt", "s + d + i AS edits")
    return out.unionByName(sizes.join(edits, "utt"))
