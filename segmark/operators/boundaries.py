"""Boundary sets and their one-to-one matching within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from segmark.functions import arrow as ar
from segmark.functions.matching import match_counts


def boundary_times(intervals: Column) -> Column:
    """All onsets plus the offset of the last list item, distinct and sorted."""
    onsets = intervals["start_s"]
    last = F.try_element_at(intervals, F.lit(-1))["end_s"]
    return F.when(F.size(intervals) == 0, F.array().cast("array<double>")).otherwise(
        F.array_sort(F.array_distinct(F.concat(onsets, F.array(last))))
    )


def tolerance_tags(tolerances: Sequence[float]) -> dict[str, float]:
    """Column tag (whole milliseconds, ties to even) to tolerance; a repeated tag keeps the last."""
    return {str(round(t * 1000)): float(t) for t in tolerances}


def boundary_hits(tolerances: Sequence[float]):
    """Vectorised function (ref boundaries, hyp boundaries) -> hits per tolerance."""
    tols = [float(t) for t in tolerances]

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def hits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        refs = ar.lists_to_numpy(ref, ref.flatten().to_numpy(zero_copy_only=False))
        hyps = ar.lists_to_numpy(hyp, hyp.flatten().to_numpy(zero_copy_only=False))
        table = np.stack([match_counts(refs, hyps, t) for t in tols], axis=1).astype(np.int32)
        return ar.list_column(list(table), pa.array(table.ravel()))

    return hits


def with_boundary_counts(recordings: DataFrame, tolerances: Sequence[float]) -> DataFrame:
    """Add b_ref, b_hyp and, per tolerance tag, tp_<tag>, fp_<tag>, fn_<tag>."""
    tags = tolerance_tags(tolerances)
    b = recordings.select(
        "*", boundary_times(F.col("ref")).alias("rb"), boundary_times(F.col("hyp")).alias("hb")
    ).withColumn("hits", boundary_hits(list(tags.values()))("rb", "hb"))
    cols = ["size(rb) AS b_ref", "size(hb) AS b_hyp"]
    for k, tag in enumerate(tags):
        cols += [
            f"hits[{k}] AS tp_{tag}",
            f"size(hb) - hits[{k}] AS fp_{tag}",
            f"size(rb) - hits[{k}] AS fn_{tag}",
        ]
    return b.selectExpr(*recordings.columns, *cols)


def boundary_counts_native(recordings: DataFrame, tolerance: float) -> Column:
    """The same hit count as one fold of built-in functions (second implementation, for checks)."""
    ref, hyp = boundary_times(F.col("ref")), boundary_times(F.col("hyp"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"))

    def step(acc: Column, r: Column) -> Column:
        spots = F.filter(
            F.transform(hyp, lambda h, j: F.struct(F.abs(h - r).alias("gap"), j.alias("j"))),
            lambda s: (s["gap"] <= tolerance) & ~F.array_contains(acc["used"], s["j"]),
        )
        best = F.array_min(spots)
        return F.when(best.isNull(), acc).otherwise(
            F.struct(F.array_append(acc["used"], best["j"]).alias("used"), (acc["tp"] + 1).alias("tp"))
        )

    return F.aggregate(ref, start, step, lambda acc: acc["tp"])
