"""Alignment, boundary matching, error statistics, reports, and the whole evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.functions.labels import CustomRules
from segmark.operators import anylength, boundaries, large, metrics, seqalign
from segmark.plans import evaluation
from segmark.session import cut, cut_path
from segmark.sources import manifest, runstore
from segmark.suite import query
from segmark.suite.intervals import _OFFSET
from segmark.suite.labels import identity

DIGITS = 9

# Recordings as lists; ``{ref}`` and ``{hyp}`` name the interval views.
_LISTS = """
    rl as (select utt, any_value(style) as style, list(phoneme order by pos) as rp,
                  list(start_s order by pos) as rs, list(end_s order by pos) as re from {ref} group by utt),
    hl as (select utt, list(phoneme order by pos) as hp, list(start_s order by pos) as hs,
                  list(end_s order by pos) as he from {hyp} group by utt),
    u as (select *, len(rp) as n, len(hp) as m from rl join hl using (utt))"""

# The edit table one reference label at a time, then the path back from its end.
_PATH = """
    dp as (
        select utt, 0::bigint as i, range(0, m + 1) as cells from u
        union all
        select utt, i + 1,
               list_transform(range(0, m + 1), lambda j:
                 list_min(list_transform(range(0, j + 1), lambda k: best[k + 1] - k)) + j)
        from (select d.utt, d.i, u.m,
                     list_concat([d.i + 1], list_transform(range(1, u.m + 1), lambda j:
                       least(d.cells[j] + (case when u.rp[d.i + 1] = u.hp[j] then 0 else 1 end),
                             d.cells[j + 1] + 1))) as best
              from dp d join u on d.utt = u.utt where d.i < u.n)),
    bt as (
        select utt, n::bigint as i, m::bigint as j, 'end' as mv from u
        union all
        select utt, i - (mv <> 'ins')::int, j - (mv <> 'del')::int, mv
        from (select b.utt, b.i, b.j,
                     case when b.i > 0 and b.j > 0
                            and c.cells[b.j + 1] = p.cells[b.j] + (case when u.rp[b.i] = u.hp[b.j] then 0 else 1 end)
                            then 'pair'
                          when b.i > 0 and c.cells[b.j + 1] = p.cells[b.j + 1] + 1 then 'del'
                          else 'ins' end as mv
              from bt b join u on b.utt = u.utt
              join dp c on c.utt = b.utt and c.i = b.i
              left join dp p on p.utt = b.utt and p.i = b.i - 1
              where b.i > 0 or b.j > 0)),
    path as (
        select utt, case when mv <> 'ins' then i end as ref_idx, case when mv <> 'del' then j end as hyp_idx, mv
        from bt where mv <> 'end'),
    pairs as (
        select p.utt, u.style, ref_idx, hyp_idx, u.rp[ref_idx + 1] as ref_phoneme, u.hp[hyp_idx + 1] as hyp_phoneme,
               u.rs[ref_idx + 1] as rs, u.re[ref_idx + 1] as re, u.hs[hyp_idx + 1] as hs, u.he[hyp_idx + 1] as he,
               case when mv <> 'pair' then mv
                    when u.rp[ref_idx + 1] = u.hp[hyp_idx + 1] then 'match' else 'sub' end as op
        from path p join u using (utt))"""

_ERRORS = """
    errs as (
        select utt, style, ref_phoneme as phoneme, ref_idx, hyp_idx, rs, re, hs, he,
               (hs - rs) * 1000.0 as signed_start, (he - re) * 1000.0 as signed_end,
               abs(hs - rs) * 1000.0 as start_err, abs(he - re) * 1000.0 as end_err,
               abs((he - hs) - (re - rs)) * 1000.0 as dur_err,
               abs((hs + he) / 2 - (rs + re) / 2) * 1000.0 as mid_err
        from pairs where op = 'match')"""

# Boundary lists and the greedy matching, one reference boundary at a time, for both tolerances.
_BOUNDS = """
    b as (select utt, style, n, m,
                 list_sort(list_distinct(list_append(rs, re[-1]))) as rb,
                 list_sort(list_distinct(list_append(hs, he[-1]))) as hb from u),
    gm as (
        select utt, tol, 0::bigint as k, []::bigint[] as used from b, (values (0.02::double), (0.05)) t(tol)
        union all
        select utt, tol, k + 1, case when best is null then used else list_append(used, best.j) end
        from (select g.utt, g.tol, g.k, g.used,
                     list_min(list_transform(
                       list_filter(range(1, len(b.hb) + 1), lambda j:
                         abs(b.hb[j] - b.rb[g.k + 1]) <= g.tol and not list_contains(g.used, j)),
                       lambda j: {'gap': abs(b.hb[j] - b.rb[g.k + 1]), 'j': j})) as best
              from gm g join b on g.utt = b.utt where g.k < len(b.rb))),
    hits as (
        select b.utt, b.style, g.tol, len(b.rb) as b_ref, len(b.hb) as b_hyp, len(g.used) as tp
        from gm g join b on g.utt = b.utt where g.k = len(b.rb))"""


def _chain(ref: str = "ref_iv", hyp: str = "hyp_iv", bounds: bool = True, extra: str = "", views=()) -> str:
    parts = [_LISTS.format(ref=ref, hyp=hyp), _PATH, _ERRORS] + ([_BOUNDS] if bounds else [])
    head = fx.with_views("ref_iv", "hyp_iv", *views, recursive=True)
    return head + "," + (extra + "," if extra else "") + ",".join(parts)


def _stats(cap: str = "150") -> str:
    within = f"x <= {cap}" if cap else "true"
    pairs = {
        "aas_ms": f"avg(x) filter (where {within})",
        "median_be_ms": f"quantile_cont(x, 0.5) filter (where {within})",
        "onset_bias_ms": "avg(signed_start) filter (where side = 's')",
        "offset_bias_ms": "avg(signed_end) filter (where side = 's')",
        "median_start_ms": "quantile_cont(x, 0.5) filter (where side = 's')",
        "mean_start_ms": "avg(x) filter (where side = 's')",
        "median_end_ms": "quantile_cont(x, 0.5) filter (where side = 'e')",
        "mean_end_ms": "avg(x) filter (where side = 'e')",
        "p90_ms": "quantile_cont(x, 0.9)",
        "pct_gt_50ms": "avg((x > 50)::int) * 100",
        "pct_gt_100ms": "avg((x > 100)::int) * 100",
        "pct_within_20ms": "avg((x <= 20)::int) * 100",
        "mean_dur_ms": "avg(dur_err) filter (where side = 's')",
        "median_dur_ms": "quantile_cont(dur_err, 0.5) filter (where side = 's')",
        "pct_dur_gt_50ms": "avg((dur_err > 50)::int) filter (where side = 's') * 100",
    }
    cols = ["count(*) filter (where side = 's') as k"] + [f"round({e}, {DIGITS}) as {n}" for n, e in pairs.items()]
    return ", ".join(cols)


_SIDES = """
    edges as (select *, 's' as side, start_err as x from errs union all select *, 'e', end_err from errs)"""


def _report_sql(chain: str, cap: str = "150", tols=(("20", "0.02"), ("50", "0.05"))) -> str:
    stat_names = ["k"] + [f for f in metrics.STATS if f != "k"]
    tp = ", ".join(f"max(tp) filter (where tol = {t}) as tp_{n}" for n, t in tols)
    tp_sum = ", ".join(f"sum(tp_{n})::double as tp_{n}" for n, _ in tols)
    f1 = ", ".join(
        f"""round(tp_{n} / nullif(b_hyp, 0) * 100, {DIGITS}) as p_{n}ms_pct,
            round(tp_{n} / nullif(b_ref, 0) * 100, {DIGITS}) as r_{n}ms_pct,
            round(case when tp_{n} > 0 then 2 * (tp_{n} / b_hyp) * (tp_{n} / b_ref) / (tp_{n} / b_hyp + tp_{n} / b_ref) * 100
                       else 0.0 end, {DIGITS}) as f1_{n}ms_pct"""
        for n, _ in tols
    )
    return (
        chain
        + ","
        + _SIDES
        + f""",
    ops as (select utt, count(*) filter (where op = 'sub') as s, count(*) filter (where op = 'del') as d,
                   count(*) filter (where op = 'ins') as i from pairs group by utt),
    per_hit as (select utt, max(b_ref) as b_ref, max(b_hyp) as b_hyp, {tp} from hits group by utt),
    counts as (select u.style, u.utt, n, m, b_ref, b_hyp, s, d, i, {", ".join("tp_" + n for n, _ in tols)}
               from u join per_hit using (utt) join ops using (utt)),
    c as (select grouping(style, utt) as g, style, utt, sum(n) as n_ref, sum(m) as n_hyp, sum(b_ref) as b_ref,
                 sum(b_hyp) as b_hyp, sum(s) as s, sum(d) as d, sum(i) as i, {tp_sum}
          from counts group by grouping sets ((style, utt), (style), ())),
    e as (select grouping(style, utt) as g, style, utt, {_stats(cap)}
          from edges group by grouping sets ((style, utt), (style), ()))
    select case c.g when 0 then 'file' when 1 then 'style' else 'global' end as level,
           case c.g when 0 then c.utt when 1 then 'STYLE_' || c.style else 'GLOBAL' end as "group",
           coalesce(c.style, 'ALL') as style, {", ".join("e." + s for s in stat_names)},
           n_ref::bigint as n_ref, n_hyp::bigint as n_hyp, b_ref::bigint as b_ref, b_hyp::bigint as b_hyp,
           round((s + d + i)::double / nullif(n_ref, 0) * 100, {DIGITS}) as per_pct,
           d::bigint as deletions, i::bigint as insertions, {f1}
    from c left join e on c.g = e.g and c.style is not distinct from e.style and c.utt is not distinct from e.utt"""
    )


def rounded(df, digits: int = DIGITS):
    return df.selectExpr(
        *[f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes]
    )


def given(spark, sf_dir):
    """The store, its order column and the bound on recording length."""
    return fx.two_sided(spark, sf_dir), "ord", fx.longest_side(spark, sf_dir)


@query("q_align_pairs", _chain(bounds=False) + " select utt, ref_idx, hyp_idx, ref_phoneme, hyp_phoneme, op from pairs")
def q_align_pairs(spark, sf_dir):
    pairs = anylength.pair_rows(*given(spark, sf_dir))
    return pairs.select(
        "utt",
        F.col("ref_idx").cast("long").alias("ref_idx"),
        F.col("hyp_idx").cast("long").alias("hyp_idx"),
        "ref_phoneme",
        "hyp_phoneme",
        "op",
    )


@query(
    "q_pair_errors",
    _chain(bounds=False)
    + """ select utt, style, phoneme, ref_idx, hyp_idx, signed_start, signed_end, start_err, end_err, dur_err, mid_err
          from errs""",
)
def q_pair_errors(spark, sf_dir):
    times = anylength.matched_times(*given(spark, sf_dir))
    times = times.selectExpr("*", "struct(rs AS start_s, re AS end_s) AS r", "struct(hs AS start_s, he AS end_s) AS h")
    errors = [f"{e} AS {n}" for n, e in seqalign.boundary_errors().items()]
    index = [f"CAST({c} AS BIGINT) AS {c}" for c in ("ref_idx", "hyp_idx")]
    return times.selectExpr("utt", "style", "phoneme", *index, *errors)


@query(
    "q_match_filtered",
    _chain(bounds=False)
    + """ select utt, ref_idx, hyp_idx, abs(rs - hs) as start_err_s, abs(re - he) as end_err_s,
                 abs((re - rs) - (he - hs)) as dur_err_s, abs((rs + re) / 2 - (hs + he) / 2) as mid_err_s,
                 count(*) filter (where abs((rs + re) / 2 - (hs + he) / 2) > 0.1) over (partition by utt) as filtered
          from errs qualify abs((rs + re) / 2 - (hs + he) / 2) <= 0.1""",
)
def q_match_filtered(spark, sf_dir):
    times = anylength.matched_times(*given(spark, sf_dir))
    kept, counts = seqalign.match_filtered(times, 0.1)
    return kept.join(counts.select("utt", "filtered"), "utt").withColumns(
        {c: F.col(c).cast("long") for c in ("ref_idx", "hyp_idx")}
    )


@query(
    "q_boundary_times",
    fx.with_views("hyp_iv", "ref_iv")
    + ","
    + _LISTS.format(ref="ref_iv", hyp="hyp_iv")
    + """
    select utt, unnest(list_distinct(list_append(hs, he[-1]))) as t from u""",
)
def q_boundary_times(spark, sf_dir):
    store = fx.one_side(spark, sf_dir, "hyp").withColumn("side", F.lit("hyp"))
    return large.boundary_rows(store).select("utt", "t")


@query(
    "q_boundary_f1_counts",
    fx.with_views("ref_iv", "hyp_iv", recursive=True)
    + ","
    + _LISTS.format(ref="ref_iv", hyp="hyp_iv")
    + ","
    + _BOUNDS
    + """
    select utt, max(b_ref) as b_ref, max(b_hyp) as b_hyp,
           max(tp) filter (where tol = 0.02) as tp_20, max(b_hyp - tp) filter (where tol = 0.02) as fp_20,
           max(b_ref - tp) filter (where tol = 0.02) as fn_20,
           max(tp) filter (where tol = 0.05) as tp_50, max(b_hyp - tp) filter (where tol = 0.05) as fp_50,
           max(b_ref - tp) filter (where tol = 0.05) as fn_50
    from hits group by utt""",
)
def q_boundary_f1_counts(spark, sf_dir):
    store, order, longest = given(spark, sf_dir)
    counted = anylength.boundary_counts(store, metrics.DEFAULT_TOLERANCES, order, longest)
    names = [c for c in counted.columns if c not in ("utt", "style")]
    return counted.select("utt", *[F.col(c).cast("long").alias(c) for c in names])


@query(
    "q_boundary_f1_native",
    fx.with_views("ref_iv", "hyp_iv", recursive=True)
    + ","
    + _LISTS.format(ref="ref_iv", hyp="hyp_iv")
    + ","
    + _BOUNDS
    + " select utt, tp from hits where tol = 0.02",
)
def q_boundary_f1_native(spark, sf_dir):
    store, order, _ = given(spark, sf_dir)
    r = seqalign.gather(store, order)
    return r.select("utt", boundaries.boundary_counts_native(r, 0.02).cast("long").alias("tp"))


@query(
    "q_boundary_f1",
    fx.with_views("ref_iv", "hyp_iv", recursive=True)
    + ","
    + _LISTS.format(ref="ref_iv", hyp="hyp_iv")
    + ","
    + _BOUNDS
    + f"""
    select style, round(sum(tp)::double / sum(b_hyp) * 100, {DIGITS}) as p_20ms_pct,
           round(sum(tp)::double / sum(b_ref) * 100, {DIGITS}) as r_20ms_pct,
           round(2 * (sum(tp)::double / sum(b_hyp)) * (sum(tp)::double / sum(b_ref))
                 / (sum(tp)::double / sum(b_hyp) + sum(tp)::double / sum(b_ref)) * 100, {DIGITS}) as f1_20ms_pct
    from hits where tol = 0.02 group by style""",
)
def q_boundary_f1(spark, sf_dir):
    store, order, longest = given(spark, sf_dir)
    counted = anylength.boundary_counts(store, [0.02], order, longest)
    sums = counted.groupBy("style").agg(*[F.sum(f"{x}_20").alias(f"{x}_20") for x in ("tp", "fp", "fn")])
    return rounded(sums.selectExpr("style", *metrics.f1_columns("20")))


@query(
    "q_per",
    fx.with_views("ref_iv", "hyp_iv")
    + f""",
    r as (select utt, any_value(style) as style, string_agg(phoneme[1], '' order by pos) as t, count(*) as n
          from ref_iv group by utt),
    h as (select utt, string_agg(phoneme[1], '' order by pos) as t from hyp_iv group by utt),
    e as (select r.utt, r.style, r.n, levenshtein(r.t, h.t) as d from r join h using (utt))
    select case grouping(style, utt) when 0 then utt when 1 then 'STYLE_' || style else 'GLOBAL' end as "group",
           sum(n)::bigint as n_ref, sum(d)::bigint as edits, round(sum(d)::double / sum(n) * 100, {DIGITS}) as per_pct
    from e group by grouping sets ((style, utt), (style), ())""",
)
def q_per(spark, sf_dir):
    # The five labels start with five different letters, so their first letters can stand for them in SQL.
    edits = anylength.label_error_rate(*given(spark, sf_dir))
    rolled = edits.rollup("style", "utt").agg(
        F.grouping_id().alias("gid"), F.sum("n_ref").alias("n_ref"), F.sum("edits").alias("edits")
    )
    return rolled.select(
        F.when(F.col("gid") == 0, F.col("utt"))
        .when(F.col("gid") == 1, F.concat(F.lit("STYLE_"), "style"))
        .otherwise("GLOBAL")
        .alias("group"),
        "n_ref",
        "edits",
        F.round(F.col("edits") / F.col("n_ref") * 100, DIGITS).alias("per_pct"),
    )


def scored(spark, sf_dir, options=metrics.ScoreOptions()):
    return metrics.score(fx.two_sided(spark, sf_dir), options, "ord", fx.longest_side(spark, sf_dir))


@query(
    "q_boundary_stats",
    _chain(bounds=False) + "," + _SIDES + f" select style, {_stats()} from edges group by style",
)
def q_boundary_stats(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(metrics.boundary_stats(s.errors, ["style"], at_most=s.values))


@query(
    "q_per_phoneme",
    _chain(bounds=False) + "," + _SIDES + f" select phoneme, {_stats()} from edges group by phoneme",
)
def q_per_phoneme(spark, sf_dir):
    return rounded(metrics.per_phoneme(scored(spark, sf_dir)))


@query("q_metrics_report", _report_sql(_chain()))
def q_metrics_report(spark, sf_dir):
    return rounded(metrics.report(scored(spark, sf_dir)))


@query(
    "q_rescore",
    _report_sql(_chain().replace("(values (0.02::double), (0.05)) t(tol)", "(values (0.01::double), (0.1)) t(tol)"),
                cap="", tols=(("10", "0.01"), ("100", "0.1"))),
)
def q_rescore(spark, sf_dir):
    both = fx.one_side(spark, sf_dir, "ref").withColumn("side", F.lit("ref")).unionByName(
        fx.one_side(spark, sf_dir, "hyp").withColumn("side", F.lit("hyp"))
    )
    path = cut_path(spark, "store")
    runstore.write_store(both, path)
    return rounded(evaluation.rescore(spark, path, metrics.ScoreOptions((0.01, 0.1), None)))


_GROUPS = """
    gm0 as (select trim(file) as key, case when trim(style) = '' then 'ALL' else trim(style) end as grp, line_no
            from group_rows where trim(file) <> ''),
    gmap as (select key, arg_max(grp, line_no) as grp from gm0 group by key)"""

_RESTYLED = """
    ref_job as (select m.utt, m.file, coalesce(g1.grp, g2.grp, 'ALL') as style, pos, phoneme, start_s, end_s
                from moved m left join gmap g1 on g1.key = m.utt left join gmap g2 on g2.key = m.file)"""


@query(
    "q_evaluation_job",
    _report_sql(
        _chain("ref_job", extra=_OFFSET + "," + _GROUPS + "," + _RESTYLED, views=("durations", "group_rows"))
    ),
)
def q_evaluation_job(spark, sf_dir):
    raw = cut(
        fx.two_sided(spark, sf_dir).withColumnRenamed("phoneme", "label").withColumnRenamed("ord", "pos"), "raw"
    )
    sides = {s: raw.filter(F.col("side") == s).select("utt", "pos", "label", "start_s", "end_s") for s in ("ref", "hyp")}
    files = (
        fx.table(spark, sf_dir, "events")
        .select(F.concat(F.lit("u"), "user_id").alias("stem"))
        .distinct()
        .withColumn("audio_path", F.concat(F.lit("audio/"), "stem", F.lit(".wav")))
    )
    grouped = manifest.assign_groups(files, manifest.group_map(fx.group_rows(spark, sf_dir)))
    samples = grouped.select(
        F.col("stem").alias("utt"), F.concat("stem", F.lit(".wav")).alias("file"), F.col("group").alias("style")
    )
    result = evaluation.evaluate_tables(
        samples, sides["ref"], sides["hyp"], fx.durations(spark, sf_dir), evaluation.EvaluationOptions()
    )
    return rounded(result.report)


def _shout(raw: pd.Series) -> pd.Series:
    """A caller's own rule that cannot read some starred labels: it raises on the whole batch that holds one."""
    if raw.str.match(r"\*[qxyz]").any():
        raise ValueError("a label that the rule cannot read")
    return raw.where(raw != "").str.upper()


@query(
    "q_failures",
    fx.with_views("raw_labels")
    + rf""",
    n as (select utt, label, {identity("label")} as phoneme, label like '[[%' and length(label) >= 21 as heard from raw_labels),
    s as (select utt, count(phoneme) as n_ref, count(phoneme) filter (where heard) as n_hyp from n group by utt),
    c as (select utt, count(*) filter (where label <> '') as n_ref, count(*) filter (where heard) as n_hyp,
                 bool_or(regexp_matches(label, '^\*[qxyz]')) as raised from n group by utt)
    select 'presets' as rules, utt, 'no label is left to score: ' || n_ref || ' in the reference, ' || n_hyp
                || ' in the hypothesis' as reason
    from s where n_ref = 0 or n_hyp = 0
    union all
    select 'own', utt, case when raised then 'ValueError: a label that the rule cannot read' else 'no label is left to score: ' || n_ref
                || ' in the reference, ' || n_hyp || ' in the hypothesis' end
    from c where raised or n_ref = 0 or n_hyp = 0""",
)
def q_failures(spark, sf_dir):
    # The hypothesis hears only long remarks, so short turns end up without one. A second run uses a rule that raises.
    ref = fx.raw_labels(spark, sf_dir)
    hyp = ref.filter(F.startswith("label", F.lit("[[")) & (F.length("label") >= 21))
    samples = ref.select("utt", F.col("utt").alias("file"), F.lit("ALL").alias("style")).distinct()
    own = CustomRules(F.pandas_udf(_shout, "string"))
    runs = {"presets": evaluation.EvaluationOptions(), "own": evaluation.EvaluationOptions(ref_rules=own, hyp_rules=own)}
    failures = [
        evaluation.build_store(samples, ref, hyp, None, o).failures.select(F.lit(name).alias("rules"), "utt", "reason")
        for name, o in runs.items()
    ]
    return failures[0].unionByName(failures[1])


@query(
    "q_run_summary",
    fx.with_views("raw_labels")
    + f""",
    n as (select utt, {identity("label")} as phoneme, label like '[[%' and length(label) >= 21 as heard from raw_labels),
    s as (select utt, count(phoneme) as n_ref, count(phoneme) filter (where heard) as n_hyp from n group by utt)
    select case when n_ref = 0 or n_hyp = 0 then 'failed' else 'evaluated' end as what, count(*) as n
    from s where not contains(utt, '_0') group by 1
    union all
    select 'skipped: excluded', count(*) from s where contains(utt, '_0') having count(*) > 0""",
)
def q_run_summary(spark, sf_dir):
    # First turns are excluded by name, as an exclusion list would.
    ref = fx.raw_labels(spark, sf_dir)
    hyp = ref.filter(F.startswith("label", F.lit("[[")) & (F.length("label") >= 21))
    pairs = ref.select("utt").distinct().withColumn("reason", F.when(F.contains("utt", F.lit("_0")), "excluded"))
    samples = pairs.filter(F.col("reason").isNull()).select("utt", F.col("utt").alias("file"), F.lit("ALL").alias("style"))
    store = evaluation.build_store(samples, ref, hyp, None, evaluation.EvaluationOptions())
    return manifest.run_summary(pairs, store.recordings, store.failures)
