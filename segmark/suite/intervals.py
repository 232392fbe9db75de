"""Interval tables: arrays, shifts, offsets, inventories, timelines, stores, annotation text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.operators import intervals as iv
from segmark.operators import metrics
from segmark.session import cut, cut_folder
from segmark.sources import runstore, textgrid
from segmark.suite import query


@query(
    "q_interval_arrays",
    fx.with_views("ref_iv")
    + """
    select utt, string_agg(phoneme, ' ' order by pos) as phones, count(*) as n,
           arg_min(start_s, pos) as first_s, arg_max(end_s, pos) as last_s,
           arg_max(phoneme, pos) as last_label
    from ref_iv group by utt""",
)
def q_interval_arrays(spark, sf_dir):
    a = iv.interval_arrays(fx.one_side(spark, sf_dir, "ref"))
    return a.select(
        "utt",
        F.array_join("phones", " ").alias("phones"),
        F.size("tuples").cast("long").alias("n"),
        F.element_at("tuples", 1)["start_s"].alias("first_s"),
        F.element_at("tuples", -1)["end_s"].alias("last_s"),
        F.element_at("tuples", -1)["phoneme"].alias("last_label"),
    )


@query(
    "q_shift_intervals",
    fx.with_views("hyp_iv", "durations")
    + """
    select utt, pos, phoneme, start_s - duration_s as start_s, end_s - duration_s as end_s
    from hyp_iv join durations using (utt)""",
)
def q_shift_intervals(spark, sf_dir):
    offsets = fx.durations(spark, sf_dir).withColumnRenamed("duration_s", "offset_s")
    rows = iv.shift_by_recording(fx.one_side(spark, sf_dir, "hyp"), offsets)
    return rows.select("utt", "pos", "phoneme", "start_s", "end_s")


_OFFSET = """
    ends as (select utt, arg_min(start_s, pos) as first_s, arg_max(end_s, pos) as last_s from ref_iv group by utt),
    moved as (select r.utt, r.file, r.style, r.pos, r.phoneme,
                     r.start_s - case when last_s > duration_s + 0.5 then first_s else 0.0 end as start_s,
                     r.end_s - case when last_s > duration_s + 0.5 then first_s else 0.0 end as end_s
              from ref_iv r join ends using (utt) join durations using (utt))"""


@query(
    "q_offset_correction",
    fx.with_views("ref_iv", "durations") + "," + _OFFSET + " select utt, pos, phoneme, start_s, end_s from moved",
)
def q_offset_correction(spark, sf_dir):
    rows = iv.correct_offset(fx.one_side(spark, sf_dir, "ref"), fx.durations(spark, sf_dir))
    return rows.select("utt", "pos", "phoneme", "start_s", "end_s")


@query(
    "q_total_duration",
    fx.with_views("hyp_iv") + " select utt, round(sum(end_s - start_s), 9) as total_s from hyp_iv group by utt",
)
def q_total_duration(spark, sf_dir):
    t = iv.total_duration(fx.one_side(spark, sf_dir, "hyp"))
    return t.select("utt", F.round("total_s", 9).alias("total_s"))


@query(
    "q_phoneme_strings",
    fx.with_views("hyp_iv") + " select utt, string_agg(phoneme, ' ' order by pos) as phonemes from hyp_iv group by utt",
)
def q_phoneme_strings(spark, sf_dir):
    return iv.phoneme_strings(fx.one_side(spark, sf_dir, "hyp")).select("utt", "phonemes")


@query(
    "q_etf",
    fx.with_views("hyp_iv")
    + """,
    targets as (select distinct utt, phoneme as target from hyp_iv)
    select utt, start_s, end_s - start_s as duration_s, target,
           case when phoneme = target then 't' else 'f' end as decision
    from hyp_iv join targets using (utt) where end_s - start_s > 0""",
)
def q_etf(spark, sf_dir):
    return iv.etf_rows(fx.one_side(spark, sf_dir, "hyp"))


@query(
    "q_inventory",
    fx.with_views("ref_iv", "hyp_iv")
    + """,
    sides as (select phoneme, 1 as r, 0 as h from ref_iv union all select phoneme, 0, 1 from hyp_iv)
    select phoneme, max(r) = 1 as in_ref, max(h) = 1 as in_hyp from sides group by phoneme""",
)
def q_inventory(spark, sf_dir):
    return metrics.inventory(fx.two_sided(spark, sf_dir))


@query(
    "q_store_roundtrip",
    fx.with_views("ref_iv", "hyp_iv")
    + """
    select utt, file, style, 'ref' as side, pos, phoneme, start_s, end_s from ref_iv
    union all select utt, file, style, 'hyp', pos, phoneme, start_s, end_s from hyp_iv""",
)
def q_store_roundtrip(spark, sf_dir):
    both = fx.one_side(spark, sf_dir, "ref").withColumn("side", F.lit("ref")).unionByName(
        fx.one_side(spark, sf_dir, "hyp").withColumn("side", F.lit("hyp"))
    )
    path = f"{cut_folder(spark)}/store-{uuid.uuid4().hex}"
    runstore.write_store(both, path)
    return runstore.read_store(spark, path)


@query(
    "q_textgrid_ingest",
    fx.with_views("hyp_iv")
    + """
    select utt, 'phones' as tier_name, pos, phoneme as label, start_s, end_s from hyp_iv
    union all
    select utt, 'words', 0, 'one "two" 3', 0.0, max(end_s) from hyp_iv group by utt""",
)
def q_textgrid_ingest(spark, sf_dir):
    texts = textgrid.long_form(fx.one_side(spark, sf_dir, "hyp"))
    found = cut(textgrid.tiers(texts), "tiers")
    parts = [
        textgrid.read_intervals(found, choice)[0].withColumn("tier_name", F.lit(name))
        for name, choice in (("phones", textgrid.TierChoice()), ("words", textgrid.TierChoice(index=0)))
    ]
    return parts[0].unionByName(parts[1]).withColumn("pos", F.col("pos").cast("long"))


@query(
    "q_tier_names",
    fx.with_views("hyp_iv")
    + """,
    u as (select distinct utt from hyp_iv)
    select utt, 0::bigint as tier_pos, 'words' as tier_name from u union all select utt, 1, 'phones' from u""",
)
def q_tier_names(spark, sf_dir):
    found = textgrid.tiers(textgrid.long_form(fx.one_side(spark, sf_dir, "hyp")))
    return textgrid.tier_names(found).withColumn("tier_pos", F.col("tier_pos").cast("long"))


_NAMES = """
    select doc_id, case when n_chars < 100 then []
                        else list_filter([source, case when n_chars > 1000 then 'Phones' else 'words' end,
                                   case lang when 'en' then 'phones' when 'de' then 'Segments' else lang end,
                                   'PHON-' || lang], lambda x: x is not null) end as names
    from documents"""


@query(
    "q_tier_select",
    f"with n as ({_NAMES}),"
    + """
    l as (select *, list_transform(names, lambda x: lower(x)) as low from n),
    p as (
        select doc_id, names, low,
               list_position(names, 'Phones') as exact,
               list_position(list_transform(low, lambda x: contains(x, 'phon')), true) as part,
               case when len(names) >= 2 then len(names) - 1 end as minus_two,
               coalesce(
                 (select max(i) from (select unnest(range(1, len(low) + 1)) as i) where low[i] = 'phones'),
                 (select max(i) from (select unnest(range(1, len(low) + 1)) as i) where low[i] = 'phonemes'),
                 (select max(i) from (select unnest(range(1, len(low) + 1)) as i) where low[i] = 'phone'),
                 (select max(i) from (select unnest(range(1, len(low) + 1)) as i) where low[i] = 'phon'),
                 (select max(i) from (select unnest(range(1, len(low) + 1)) as i) where low[i] = 'segments'),
                 case when len(low) > 0 then 1 end) as usual
        from l)
    select doc_id, names[nullif(exact, 0)] as by_name, names[nullif(part, 0)] as by_part,
           names[minus_two] as by_index, names[usual] as by_default
    from p""",
)
def q_tier_select(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    names = F.array(
        "source",
        F.when(F.col("n_chars") > 1000, "Phones").otherwise("words"),
        F.when(F.col("lang") == "en", "phones").when(F.col("lang") == "de", "Segments").otherwise(F.col("lang")),
        F.concat(F.lit("PHON-"), "lang"),
    )
    empty = F.array().cast("array<string>")
    d = d.withColumn("names", F.when(F.col("n_chars") < 100, empty).otherwise(names))
    choices = {
        "by_name": textgrid.TierChoice(tier="Phones"),
        "by_part": textgrid.TierChoice(contains="Phon"),
        "by_index": textgrid.TierChoice(index=-2),
        "by_default": textgrid.TierChoice(),
    }
    picked = [
        F.try_element_at("names", textgrid.choose_tier(F.col("names"), c)[0].cast("int")).alias(n)
        for n, c in choices.items()
    ]
    return d.select("doc_id", *picked)
