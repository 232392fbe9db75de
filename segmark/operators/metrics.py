"""Boundary statistics, boundary F1 and label error rate per recording, group, label and overall.

All figures are pooled. Counts and sums add up, so groups and the overall row roll up from the
per-recording rows; only order statistics go back to the error rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmark.functions import text
from segmark.operators import boundaries, large, seqalign
from segmark.operators.quantiles import MAX_IN_TASK, exact_quantiles
from segmark.session import cut, small_batches

DEFAULT_CAP_MS = 150.0
DEFAULT_TOLERANCES = (0.02, 0.05)
DEFAULT_GROUP = "ALL"


@dataclass(frozen=True)
class ScoreOptions:
    """Scoring knobs: boundary tolerances in seconds, and the error cap in ms (None or 0 keeps all)."""

    tolerances: tuple[float, ...] = DEFAULT_TOLERANCES
    cap_ms: float | None = DEFAULT_CAP_MS
    max_one_task: int = seqalign.MAX_ONE_TASK

    @property
    def tags(self) -> list[str]:
        return list(boundaries.tolerance_tags(self.tolerances))


@dataclass(frozen=True)
class Scored:
    """Per-recording rows (counts, sums, quantiles) and the long error rows they come from.

    ``matches`` is the number of error rows. ``failures`` (utt, reason): recordings on which a caller's own aligner
    raised.
    """

    files: DataFrame
    errors: DataFrame
    options: ScoreOptions
    matches: int | None = None
    failures: DataFrame | None = None

    @property
    def values(self) -> int | None:
        """Bound on distinct error values: three per error row."""
        return None if self.matches is None else 3 * self.matches


def _moments(cap_ms: float | None) -> dict[str, str]:
    """Additive figures of one error record as SQL; their sums give every mean and rate.

    ``{r}`` stands for the record: ``x.`` inside a fold over an array, nothing over long rows.
    """
    within = f"<= {float(cap_ms)}D" if cap_ms else "IS NOT NULL"

    def both(test: str) -> str:
        return f"CAST({{r}}start_err {test} AS INT) + CAST({{r}}end_err {test} AS INT)"

    return {
        "m_k": "1",
        "m_n_cap": both(within),
        "m_cap": f"IF({{r}}start_err {within}, {{r}}start_err, 0D) + IF({{r}}end_err {within}, {{r}}end_err, 0D)",
        "m_signed_start": "{r}signed_start",
        "m_signed_end": "{r}signed_end",
        "m_start": "{r}start_err",
        "m_end": "{r}end_err",
        "m_dur": "{r}dur_err",
        "m_gt50": both("> 50"),
        "m_gt100": both("> 100"),
        "m_le20": both("<= 20"),
        "m_dur_gt50": "CAST({r}dur_err > 50 AS INT)",
    }


QUANTILES = ("median_be_ms", "median_start_ms", "median_end_ms", "p90_ms", "median_dur_ms")

#: Statistic columns in report order.
STATS = (
    "k",
    "aas_ms",
    "median_be_ms",
    "onset_bias_ms",
    "offset_bias_ms",
    "median_start_ms",
    "mean_start_ms",
    "median_end_ms",
    "mean_end_ms",
    "p90_ms",
    "pct_gt_50ms",
    "pct_gt_100ms",
    "pct_within_20ms",
    "mean_dur_ms",
    "median_dur_ms",
    "pct_dur_gt_50ms",
)


def _stat_columns() -> list[str]:
    """STATS as SQL from summed moments and quantile columns; NULL for an empty group."""
    by_name = {
        "k": "IF(m_k > 0, CAST(m_k AS BIGINT), NULL)",
        "aas_ms": "try_divide(m_cap, m_n_cap)",
        "onset_bias_ms": "try_divide(m_signed_start, m_k)",
        "offset_bias_ms": "try_divide(m_signed_end, m_k)",
        "mean_start_ms": "try_divide(m_start, m_k)",
        "mean_end_ms": "try_divide(m_end, m_k)",
        "pct_gt_50ms": "try_divide(m_gt50, m_k * 2) * 100",
        "pct_gt_100ms": "try_divide(m_gt100, m_k * 2) * 100",
        "pct_within_20ms": "try_divide(m_le20, m_k * 2) * 100",
        "mean_dur_ms": "try_divide(m_dur, m_k)",
        "pct_dur_gt_50ms": "try_divide(m_dur_gt50, m_k) * 100",
    }
    return [f"{by_name.get(n, n)} AS {n}" for n in STATS]


def _array_quantile(ordered: str, p: float) -> str:
    at = f"((size({ordered}) - 1) * {p}D)"
    low, high = (f"get({ordered}, CAST({f}({at}) AS INT))" for f in ("floor", "ceil"))
    return f"{low} + ({high} - {low}) * ({at} - floor({at}))"


def _file_statistics(scored: DataFrame, cap_ms: float | None) -> DataFrame:
    """Moments and quantiles of each recording straight from its error array: no shuffle."""
    sums = [
        f"aggregate(errs, 0D, (acc, x) -> acc + ({f.format(r='x.')})) AS {n}" for n, f in _moments(cap_ms).items()
    ]
    keep = [f"`{c}`" for c in scored.columns if c != "errs"]
    lists = scored.selectExpr(
        *keep,
        *sums,
        "array_sort(errs.start_err) AS l_start",
        "array_sort(errs.end_err) AS l_end",
        "array_sort(errs.dur_err) AS l_dur",
        "array_sort(concat(errs.start_err, errs.end_err)) AS l_both",
    )
    lists = lists.selectExpr("*", f"filter(l_both, x -> x <= {float(cap_ms)}D) AS l_cap" if cap_ms else "l_both AS l_cap")
    picks = {
        "median_be_ms": ("l_cap", 0.5),
        "median_start_ms": ("l_start", 0.5),
        "median_end_ms": ("l_end", 0.5),
        "p90_ms": ("l_both", 0.9),
        "median_dur_ms": ("l_dur", 0.5),
    }
    return lists.selectExpr(
        *keep, *_moments(cap_ms), *[f"{_array_quantile(c, p)} AS {n}" for n, (c, p) in picks.items()]
    )


def counted_errors(errors: DataFrame, grain: Sequence[str], at_most: int | None = None) -> DataFrame:
    """Error values with their multiplicity: ``a`` onsets, ``b`` offsets, ``c`` durations per value.

    Equal values become one row where all are known to fit a task (``at_most``); others stay rows of their own,
    which ranks by histogram need no shuffle to read.
    """
    values = (
        "inline(array(named_struct('v', start_err, 'a', 1, 'b', 0, 'c', 0),"
        " named_struct('v', end_err, 'a', 0, 'b', 1, 'c', 0),"
        " named_struct('v', dur_err, 'a', 0, 'b', 0, 'c', 1)))"
    )
    rows = errors.selectExpr(*grain, values)
    if at_most is None or at_most > MAX_IN_TASK:
        return rows
    return rows.groupBy(*grain, "v").agg(*[F.sum(c).alias(c) for c in "abc"])


def group_quantiles(
    counted: DataFrame, grain: Sequence[str], cap_ms: float | None, at_most: int | None = None
) -> DataFrame:
    """The QUANTILES of arbitrarily large groups."""
    edge = F.col("a") + F.col("b")
    capped = edge if not cap_ms else F.when(F.col("v") <= float(cap_ms), edge).otherwise(0)
    return exact_quantiles(
        counted,
        grain,
        "v",
        {
            "median_be_ms": (capped, 0.5),
            "median_start_ms": (F.col("a"), 0.5),
            "median_end_ms": (F.col("b"), 0.5),
            "p90_ms": (edge, 0.9),
            "median_dur_ms": (F.col("c"), 0.5),
        },
        at_most,
    )


def grouped_moments(errors: DataFrame, grain: Sequence[str], cap_ms: float | None) -> DataFrame:
    return errors.groupBy(*grain).agg(
        *[F.expr(f"CAST(sum({f.format(r='')}) AS DOUBLE)").alias(n) for n, f in _moments(cap_ms).items()]
    )


def boundary_stats(
    errors: DataFrame,
    grain: Sequence[str],
    cap_ms: float | None = DEFAULT_CAP_MS,
    at_most: int | None = None,
) -> DataFrame:
    """Pooled boundary statistics of error rows per grain; works for groups of any size.

    ``at_most`` is a known bound on the distinct error values (see :attr:`Scored.values`).
    """
    moments = grouped_moments(errors, grain, cap_ms)
    quantiles = group_quantiles(counted_errors(errors, grain, at_most), grain, cap_ms, at_most)
    return moments.join(quantiles, list(grain), "left").selectExpr(*grain, *_stat_columns())


def score(
    store: DataFrame,
    options: ScoreOptions = ScoreOptions(),
    order: str = "pos",
    longest: int | None = None,
    aligner: seqalign.Aligner = seqalign.align_labels,
    parts: tuple[DataFrame, DataFrame | None] | None = None,
) -> Scored:
    """Align, match and measure every recording of a long interval store.

    Recordings of ordinary length become one row each and are scored where they lie; longer ones are
    tiled. ``longest`` is the largest number of labels on one side of a recording, counted here unless
    the caller knows it; ``parts`` are the two kinds, if the caller has them apart. Another ``aligner`` gets every recording whole, whatever its length; a recording
    on which it raises is a row of ``failures`` and not scored. The scored rows are written once because
    the report reads them several times.
    """
    own = aligner is seqalign.align_labels
    if not own:
        small, big = store, None
    else:
        small, big = parts or large.split_by_length(store, options.max_one_task, longest)
    error = None if own else "failed"
    aligned = seqalign.with_errors(seqalign.align(seqalign.gather(small, order), aligner, error))
    counted = boundaries.with_boundary_counts(
        aligned.select(
            "utt",
            "file",
            "style",
            "ref",
            "hyp",
            F.size("ref").alias("n_ref"),
            F.size("hyp").alias("n_hyp"),
            "s",
            "d",
            "i",
            "errs",
            *([error] if error else []),
        ),
        options.tolerances,
    ).drop("ref", "hyp")
    with small_batches(store.sparkSession):
        scored = cut(counted.withColumn("n_match", F.size("errs")), "scored")
    failures = None
    if error:
        failures = scored.filter(F.col(error).isNotNull()).select("utt", F.col(error).alias("reason"))
        scored = scored.filter(F.col(error).isNull()).drop(error)
    matches = scored.agg(F.sum("n_match")).first()[0] or 0
    files = _file_statistics(scored.drop("n_match"), options.cap_ms)
    errors = seqalign.error_rows(scored)
    if big is not None:
        big_counts, big_errors = large.score_large(big, options.tolerances, order)
        matches += big_errors.count()
        stats = grouped_moments(big_errors, ["utt"], options.cap_ms).join(
            group_quantiles(counted_errors(big_errors, ["utt"]), ["utt"], options.cap_ms), "utt", "left"
        )
        filled = big_counts.join(stats, "utt", "left").na.fill(0.0, list(_moments(options.cap_ms)))
        files = files.unionByName(filled)
        errors = errors.unionByName(big_errors.select(*errors.columns))
    return Scored(files, errors, options, matches, failures)


def _count_columns(tags: Sequence[str]) -> list[str]:
    cols = [
        "n_ref",
        "n_hyp",
        "b_ref",
        "b_hyp",
        "try_divide(s + d + i, n_ref) * 100 AS per_pct",
        "d AS deletions",
        "i AS insertions",
    ]
    return cols + [c for t in tags for c in f1_columns(t)]


def f1_columns(tag: str) -> list[str]:
    """Precision, recall (NULL when undefined) and F1 (0 when undefined) as SQL from summed counts."""
    p, r = (f"try_divide(CAST(tp_{tag} AS DOUBLE), tp_{tag} + {x}_{tag})" for x in ("fp", "fn"))
    p0, r0 = f"coalesce({p}, 0D)", f"coalesce({r}, 0D)"
    return [
        f"{p} * 100 AS p_{tag}ms_pct",
        f"{r} * 100 AS r_{tag}ms_pct",
        f"coalesce(try_divide(2 * {p0} * {r0} * 100, {p0} + {r0}), 0D) AS f1_{tag}ms_pct",
    ]


def report(scored: Scored) -> DataFrame:
    """File rows, one row per style and one overall row, with every statistic.

    ``level`` is file, style or global: a style that happens to be called like the overall group stays
    apart from it.
    """
    tags, cap = scored.options.tags, scored.options.cap_ms
    moments = list(_moments(cap))
    counts = ["n_ref", "n_hyp", "b_ref", "b_hyp", "s", "d", "i"] + [
        f"{x}_{t}" for t in tags for x in ("tp", "fp", "fn")
    ]
    long_counts = [f"CAST({c} AS BIGINT) AS {c}" for c in counts]
    files = scored.files.selectExpr(
        "'file' AS level", "utt AS `group`", "style", *long_counts, *moments, *QUANTILES
    )
    # Grouping sets over the per-recording rows; a recording weighs one row here, however long it is.
    styles = (
        scored.files.selectExpr("style", *long_counts, *moments)
        .rollup("style")
        .agg(F.grouping_id().alias("gid"), *[F.expr(f"sum({c}) AS {c}") for c in [*counts, *moments]])
        .selectExpr(
            "IF(gid = 0, 'style', 'global') AS level",
            "IF(gid = 0, style, '') AS key",
            "IF(gid = 0, concat('STYLE_', style), 'GLOBAL') AS `group`",
            f"IF(gid = 0, style, '{DEFAULT_GROUP}') AS style",
            *counts,
            *moments,
        )
    )
    bound = None if scored.values is None else 2 * scored.values
    pooled = counted_errors(scored.errors, ["style"], bound).selectExpr(
        "inline(array(named_struct('level', 'style', 'key', style), named_struct('level', 'global', 'key', '')))",
        "v",
        "a",
        "b",
        "c",
    )
    quantiles = group_quantiles(pooled, ["level", "key"], cap, bound)
    rolled = styles.join(quantiles, ["level", "key"], "left").select(*files.columns)
    return files.unionByName(rolled).selectExpr(
        "level", "`group`", "style", *_stat_columns(), *_count_columns(tags)
    )


def per_phoneme(scored: Scored) -> DataFrame:
    """Boundary statistics per label over all recordings."""
    return boundary_stats(scored.errors, ["phoneme"], scored.options.cap_ms, scored.values)


def report_headers(tags: Sequence[str]) -> dict[str, str]:
    """Column names of the written report."""
    # Headers of the metrics file.
    names = {
        "group": "group",
        "style": "style",
        "k": "K",
        "aas_ms": "AAS (ms)",
        "median_be_ms": "MedianBE (ms)",
        "onset_bias_ms": "onset_bias (ms)",
        "offset_bias_ms": "offset_bias (ms)",
        "median_start_ms": "Median_start (ms)",
        "mean_start_ms": "Mean_start (ms)",
        "median_end_ms": "Median_end (ms)",
        "mean_end_ms": "Mean_end (ms)",
        "p90_ms": "P90 (ms)",
        "pct_gt_50ms": "%>50ms",
        "pct_gt_100ms": "%>100ms",
        "pct_within_20ms": "%within20ms",
        "mean_dur_ms": "Mean_dur (ms)",
        "median_dur_ms": "Median_dur (ms)",
        "pct_dur_gt_50ms": "%dur>50ms",
        "n_ref": "N_ref",
        "n_hyp": "N_hyp",
        "b_ref": "B_ref",
        "b_hyp": "B_hyp",
        "per_pct": "PER (%)",
        "deletions": "Deletions",
        "insertions": "Insertions",
    }
    for t in tags:
        names |= {f"p_{t}ms_pct": f"P@{t}ms (%)", f"r_{t}ms_pct": f"R@{t}ms (%)", f"f1_{t}ms_pct": f"F1@{t}ms (%)"}
    return names


def label_error_rate(recordings: DataFrame) -> DataFrame:
    """Edits and reference length per recording with built-in functions only.

    Labels of a recording are interned to single code points so that the built-in ``levenshtein``
    counts label edits. Labels holding blanks count as several words, as in the edit counts of
    :func:`score`.
    """

    def words(side: str) -> Column:
        labels = F.col(side)["phoneme"]
        return F.when(F.exists(labels, text.may_split), F.flatten(F.transform(labels, text.words))).otherwise(labels)

    staged = recordings.select(
        "utt",
        "style",
        F.size("ref").alias("n_ref"),
        words("ref").alias("rw"),
        words("hyp").alias("hw"),
    ).withColumn("known", F.array_distinct(F.concat("rw", "hw")))

    def encoded(seq: str) -> Column:
        # Index to code point, skipping the surrogate range, as big-endian UTF-32.
        code = lambda x: F.array_position("known", x) + 0x20
        point = lambda x: F.when(code(x) < 0xD800, code(x)).otherwise(code(x) + 0x800)
        hexed = F.transform(seq, lambda x: F.lpad(F.hex(point(x)), 8, "0"))
        return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-32")

    return staged.select(
        "utt", "style", "n_ref", F.levenshtein(encoded("rw"), encoded("hw")).alias("edits")
    )


def inventory(intervals: DataFrame) -> DataFrame:
    """Distinct labels with the sides they occur on."""
    return (
        intervals.groupBy("phoneme")
        .agg(
            F.max((F.col("side") == "ref").cast("int")).alias("r"),
            F.max((F.col("side") == "hyp").cast("int")).alias("h"),
        )
        .select(
            "phoneme",
            (F.col("r") == 1).alias("in_ref"),
            (F.col("h") == 1).alias("in_hyp"),
        )
    )
