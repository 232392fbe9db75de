"""Sequence alignment join: pairing the labels of two recordings by edit distance.

A recording is one row (``ref`` and ``hyp`` arrays in order); alignment then needs no further shuffle.
Recordings too long for one task go through :mod:`segmark.operators.large` instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from segmark.functions import arrow as ar
from segmark.functions.editpath import edit_counts, edit_paths
from segmark.functions.guarded import guarded
from segmark.functions.text import words_of
from segmark.session import cut

#: Longest side of a recording aligned inside one task; longer ones are tiled.
MAX_ONE_TASK = 1 << 15

PAIR = T.StructType([T.StructField("ref_idx", T.IntegerType()), T.StructField("hyp_idx", T.IntegerType())])
ALIGNED = T.StructType(
    [T.StructField("pairs", T.ArrayType(PAIR))] + [T.StructField(c, T.IntegerType()) for c in "sdi"]
)


def gather(intervals: DataFrame, order: str = "pos") -> DataFrame:
    """Long intervals (utt, file, style, side, <order>, phoneme, start_s, end_s) to one row per recording.

    One shuffle on the recording; callers keep recordings above :data:`MAX_ONE_TASK` out of it.
    """

    def side(name: str) -> Column:
        item = f"IF(side = '{name}', struct({order}, phoneme, start_s, end_s), NULL)"
        return F.expr(f"sort_array(collect_list({item})) AS {name}")

    return intervals.groupBy("utt", "file", "style").agg(side("ref"), side("hyp"))


def _align_batch(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    refs, hyps, labels = ar.shared_codes(ref, hyp)
    paths = edit_paths(refs, hyps)
    counts = np.array([edit_counts(r, h, p) for r, h, p in zip(refs, hyps, paths)], np.int32).reshape(-1, 3)
    words = [words_of(label) for label in labels.to_pylist()]
    spaced = np.array([w != [label] for w, label in zip(words, labels.to_pylist())], bool)
    if spaced.any():
        # Labels holding blanks count as several words in the edit counts (not in the pairs).
        rows = [b for b in range(len(refs)) if spaced[refs[b]].any() or spaced[hyps[b]].any()]
        codes: dict[str, int] = {}
        for word in (w for ws in words for w in ws):
            codes.setdefault(word, len(codes))

        def as_words(seq: np.ndarray) -> np.ndarray:
            return np.array([codes[w] for k in seq for w in words[k]], np.int32)

        wr, wh = [as_words(refs[b]) for b in rows], [as_words(hyps[b]) for b in rows]
        for b, r, h, p in zip(rows, wr, wh, edit_paths(wr, wh)):
            counts[b] = edit_counts(r, h, p)
    flat_i = np.concatenate([p[0] for p in paths]) if paths else np.empty(0, np.int32)
    flat_j = np.concatenate([p[1] for p in paths]) if paths else np.empty(0, np.int32)
    pairs = pa.StructArray.from_arrays(
        [pa.array(flat_i, pa.int32(), mask=flat_i < 0), pa.array(flat_j, pa.int32(), mask=flat_j < 0)],
        names=["ref_idx", "hyp_idx"],
    )
    return pa.StructArray.from_arrays(
        [ar.list_column([p[0] for p in paths], pairs), *[pa.array(counts[:, k]) for k in range(3)]],
        names=["pairs", "s", "d", "i"],
    )


@arrow_udf(ALIGNED)
def align_labels(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit path and (substitution, deletion, insertion) counts of two label arrays."""
    return _align_batch(ref, hyp)


# Not for chance: it keeps Spark from evaluating the kernel again inside filters that it derives and pushes down.
align_labels = align_labels.asNondeterministic()


#: A vectorised function of two label arrays returning ALIGNED.
Aligner = Callable[[Column, Column], Column]


def align(recordings: DataFrame, aligner: Aligner = align_labels, error: str | None = None) -> DataFrame:
    """Add ``pairs`` and the edit counts ``s, d, i`` to gathered recordings.

    ``aligner`` is any vectorised function of two label arrays returning the same struct, so a banded
    variant can be swapped in. With ``error``, a column of that name says why it raised on a recording
    (else NULL), whose pairs and counts are NULL then.
    """
    labels = [F.col(side)["phoneme"] for side in ("ref", "hyp")]
    if error is None:
        out, own = recordings.withColumn("a", aligner(*labels)), []
    else:
        out = recordings.withColumn("o", guarded(aligner)(*labels)).withColumns({"a": F.col("o.value"), error: F.col("o.error")})
        own = [error]
    return out.select(*recordings.columns, F.col("a.pairs"), F.col("a.s"), F.col("a.d"), F.col("a.i"), *own)


def pair_rows(aligned: DataFrame) -> DataFrame:
    """One row per step of the edit path, with its kind and both labels."""
    step = F.explode("pairs").alias("p")
    r, h = F.get("ref", F.col("p.ref_idx")), F.get("hyp", F.col("p.hyp_idx"))
    return aligned.select("utt", "ref", "hyp", step).select(
        "utt",
        F.col("p.ref_idx").alias("ref_idx"),
        F.col("p.hyp_idx").alias("hyp_idx"),
        r["phoneme"].alias("ref_phoneme"),
        h["phoneme"].alias("hyp_phoneme"),
        F.when(F.col("p.hyp_idx").isNull(), "del")
        .when(F.col("p.ref_idx").isNull(), "ins")
        .when(r["phoneme"] == h["phoneme"], "match")
        .otherwise("sub")
        .alias("op"),
    )


def boundary_errors(ref: str = "r.", hyp: str = "h.") -> dict[str, str]:
    """Signed and absolute boundary errors in milliseconds as SQL; positive means the hypothesis is late.

    The order of the operations is part of the result: thresholds are tested on these raw doubles.
    """
    rs, re, hs, he = f"{ref}start_s", f"{ref}end_s", f"{hyp}start_s", f"{hyp}end_s"
    return {
        "signed_start": f"({hs} - {rs}) * 1000D",
        "signed_end": f"({he} - {re}) * 1000D",
        "start_err": f"abs({hs} - {rs}) * 1000D",
        "end_err": f"abs({he} - {re}) * 1000D",
        "dur_err": f"abs(({he} - {hs}) - ({re} - {rs})) * 1000D",
        "mid_err": f"abs(({hs} + {he}) / 2D - ({rs} + {re}) / 2D) * 1000D",
    }


def with_errors(aligned: DataFrame) -> DataFrame:
    """Add ``errs``: one record per pair whose labels are equal."""
    fields = ", ".join(f"'{n}', {e}" for n, e in boundary_errors("q.r.", "q.h.").items())
    return aligned.selectExpr(
        "*",
        f"""transform(
            transform(
                filter(pairs, p -> get(ref, p.ref_idx).phoneme = get(hyp, p.hyp_idx).phoneme),
                p -> named_struct('p', p, 'r', get(ref, p.ref_idx), 'h', get(hyp, p.hyp_idx))),
            q -> named_struct('ref_idx', q.p.ref_idx, 'hyp_idx', q.p.hyp_idx, 'phoneme', q.r.phoneme, {fields})
        ) AS errs""",
    )


def error_rows(with_errs: DataFrame) -> DataFrame:
    """Long form of ``errs``."""
    return with_errs.select("utt", "style", F.inline("errs"))


def match_filtered(errors: DataFrame, max_time_diff: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched pairs with absolute errors in seconds, and how many each recording lost to the filter.

    Pairs whose midpoints differ by more than ``max_time_diff`` seconds are filtered. Diagnostics only.
    Expects ``rs, re, hs, he`` next to the pair indices.
    """
    rs, re, hs, he = (F.col(c) for c in ("rs", "re", "hs", "he"))
    rows = errors.select(
        "utt",
        "ref_idx",
        "hyp_idx",
        F.abs(rs - hs).alias("start_err_s"),
        F.abs(re - he).alias("end_err_s"),
        F.abs((re - rs) - (he - hs)).alias("dur_err_s"),
        F.abs((rs + re) / 2 - (hs + he) / 2).alias("mid_err_s"),
    )
    # Written once: the counts don't align the recordings again.
    rows = cut(rows, "matched")
    far = F.lit(False) if max_time_diff is None else F.col("mid_err_s") > max_time_diff
    kept = rows.filter(~far)
    counts = rows.groupBy("utt").agg(
        F.count_if(~far).alias("matched"), F.count_if(far).alias("filtered")
    )
    return kept, counts


def matched_times(aligned: DataFrame) -> DataFrame:
    """Pairs with equal labels and the four boundary times ``rs, re, hs, he``."""
    step = F.explode("pairs").alias("p")
    r, h = F.get("ref", F.col("p.ref_idx")), F.get("hyp", F.col("p.hyp_idx"))
    return (
        aligned.select("utt", "style", "ref", "hyp", step)
        .filter(r["phoneme"] == h["phoneme"])
        .select(
            "utt",
            "style",
            F.col("p.ref_idx").alias("ref_idx"),
            F.col("p.hyp_idx").alias("hyp_idx"),
            r["phoneme"].alias("phoneme"),
            r["start_s"].alias("rs"),
            r["end_s"].alias("re"),
            h["start_s"].alias("hs"),
            h["end_s"].alias("he"),
        )
    )
