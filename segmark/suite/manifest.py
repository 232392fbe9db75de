"""File listings: stems, pairs, groups, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.sources import manifest as mf
from segmark.suite import query

# One row per usable file with its stem; a stem carrying the suffix wins, then part order.
_STEMS = """
    parts as (select side, path, string_split(path, '/') as p from listing),
    named as (select *, p[-1] as name, lower('.' || string_split(p[-1], '.')[-1]) as ext,
                     left(p[-1], length(p[-1]) - length(string_split(p[-1], '.')[-1]) - 1) as bare from parts),
    usable as (select *, case when side = 'ref' and bare like '%-ref' then left(bare, length(bare) - 4) else bare end as stem
               from named
               where not starts_with(name, '.') and not list_contains(p, '.ipynb_checkpoints')
                 and ext in (select unnest(case when side = 'audio' then ['.wav', '.flac', '.mp3', '.ogg', '.m4a']
                                                else ['.textgrid'] end))),
    idx as (select side, stem, path from usable
            qualify row_number() over (partition by side, stem order by stem = bare, p) = 1)"""

_PAIRS = """
    pairs as (select r.stem, a.path as audio_path, r.path as ref_path, h.path as hyp_path,
                     case when r.stem in ('en1', 'de2', 'es3', 'fr4') then 'excluded'
                          when a.path is null then 'no audio file'
                          when h.path is null then 'no hypothesis TextGrid' end as reason
              from (select * from idx where side = 'ref') r
              left join (select * from idx where side = 'audio') a using (stem)
              left join (select * from idx where side = 'hyp') h using (stem))"""

_EXCLUDE = ("en1", "de2", "es3", "fr4")


def _indexed(spark, sf_dir):
    files = fx.listing(spark, sf_dir)

    def side(name, extensions, suffix=None):
        return mf.index_by_stem(files.filter(F.col("side") == name).select("path"), extensions, suffix)

    return (
        side("audio", mf.AUDIO_EXTENSIONS),
        side("ref", mf.TEXTGRID_EXTENSIONS, "-ref"),
        side("hyp", mf.TEXTGRID_EXTENSIONS),
    )


def _pairs(spark, sf_dir):
    return mf.discover_pairs(*_indexed(spark, sf_dir), exclude=_EXCLUDE)


@query("q_index_by_stem", fx.with_views("listing") + "," + _STEMS + " select side, stem, path from idx")
def q_index_by_stem(spark, sf_dir):
    sides = [d.withColumn("side", F.lit(s)) for s, d in zip(("audio", "ref", "hyp"), _indexed(spark, sf_dir))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


@query("q_discover_pairs", fx.with_views("listing") + "," + _STEMS + "," + _PAIRS + " select * from pairs")
def q_discover_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    "q_skip_reasons",
    fx.with_views("listing")
    + ","
    + _STEMS
    + ","
    + _PAIRS
    + " select reason, count(*) as n from pairs where reason is not null group by reason",
)
def q_skip_reasons(spark, sf_dir):
    return mf.skipped(_pairs(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "q_limit_samples",
    fx.with_views("listing")
    + ","
    + _STEMS
    + ","
    + _PAIRS
    + " select stem, audio_path, ref_path, hyp_path from pairs where reason is null order by stem limit 25",
)
def q_limit_samples(spark, sf_dir):
    return mf.limit_samples(mf.samples(_pairs(spark, sf_dir)), 25)


_MAP = """
    kept as (select trim(file) as key, case when trim(style) = '' then 'ALL' else trim(style) end as grp, line_no
             from group_rows where trim(file) <> ''),
    gmap as (select key, arg_max(grp, line_no) as "group" from kept group by key)"""


@query("q_group_map", fx.with_views("group_rows") + "," + _MAP + " select * from gmap")
def q_group_map(spark, sf_dir):
    return mf.group_map(fx.group_rows(spark, sf_dir))


@query(
    "q_assign_groups",
    fx.with_views("group_rows")
    + ","
    + _MAP
    + """,
    u as (select distinct utt, utt || '.wav' as file from ev)
    select utt as stem, coalesce(a."group", b."group", 'ALL') as "group",
           coalesce(a."group", b."group") is not null as matched
    from u left join gmap a on a.key = utt left join gmap b on b.key = file""",
)
def q_assign_groups(spark, sf_dir):
    users = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("stem")).distinct()
    rows = users.withColumn("audio_path", F.concat(F.lit("wav/"), "stem", F.lit(".wav")))
    groups = mf.group_map(fx.group_rows(spark, sf_dir))
    return mf.assign_groups(rows, groups).select("stem", "group", "matched")
