"""The run over folders: annotation and sound files made from events, written, listed and read back by path."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.plans.evaluation import EvaluationJob, EvaluationOptions
from segmark.operators import intervals as iv
from segmark.session import cut_path
from segmark.sources import audio, formats, manifest, stores, textgrid
from segmark.suite import query
from segmark.suite.intervals import _OFFSET

#: Folders whose names a listing or a URL parser could trip over.
FOLDERS = ("_a", "b c", "d#e", "f%20g", "ħé")


def folder_of(utt):
    return F.element_at(F.array(*(F.lit(n) for n in FOLDERS)), (F.pmod(F.xxhash64(utt), F.lit(len(FOLDERS))) + 1).cast("int"))


def sound_header(ms: int, ogg: bool) -> bytes:
    """A FLAC or OGG file of ``ms`` milliseconds without its samples."""
    if not ogg:
        info = bytearray(34)
        info[10:18] = (1000 << 44 | ms).to_bytes(8, "big")
        return b"fLaC\x00\x00\x00\x22" + bytes(info)
    head = b"\x01vorbis" + struct.pack("<IBI", 0, 1, 1000) + b"\0" * 14
    page = b"OggS\0\0" + struct.pack("<qIIIBB", 0, 1, 0, 0, 1, len(head)) + head
    return page + b"OggS\0\4" + struct.pack("<qIIIBB", ms, 1, 1, 0, 1, 1) + b"\0"


def write_files(files: DataFrame, make=None) -> None:
    """Writes (path, body) in tasks, or what ``make`` gives of the columns after the path; a task that runs twice writes the same files again."""
    def write(batches):
        for b in batches:
            for path, *rest in zip(*(c.to_pylist() for c in b.columns)):
                stores.write_bytes(path, make(*rest) if make else rest[0])
            yield b.select(["path"])

    files.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def sounds(spark, sf_dir: str, root: str) -> DataFrame:
    """(path, ms, ogg) of sound files."""
    rows = fx.durations(spark, sf_dir).select("utt", F.round(F.col("duration_s") * 1000).cast("long").alias("ms"))
    ogg = F.pmod(F.xxhash64("utt"), F.lit(3)) == 0
    path = F.concat(F.lit(f"{root}/audio/"), folder_of("utt"), F.lit("/"), "utt", F.when(ogg, ".ogg").otherwise(".flac"))
    return rows.select(path.alias("path"), "ms", ogg.alias("ogg"))


def new_root(spark) -> str:
    return cut_path(spark, "folder")


@query("q_audio_durations", fx.with_views("durations") + " select utt, duration_s from durations")
def q_audio_durations(spark, sf_dir):
    root = new_root(spark)
    write_files(sounds(spark, sf_dir, root), sound_header)
    files = manifest.index_by_stem(manifest.list_files(spark, f"{root}/audio"), manifest.AUDIO_EXTENSIONS)
    lengths = audio.durations(files.select("path"))
    return files.join(lengths, "path").select(F.col("stem").alias("utt"), "duration_s")


@query(
    "q_folder_job",
    fx.with_views("ref_iv", "hyp_iv", "durations")
    + ","
    + _OFFSET
    + """
    select 'ref' as side, utt, pos, phoneme, start_s, end_s from moved
    union all select 'hyp', utt, pos, phoneme, start_s, end_s from hyp_iv""",
)
def q_folder_job(spark, sf_dir):
    root = new_root(spark)
    write_files(sounds(spark, sf_dir, root), sound_header)
    for side, suffix in (("ref", "-ref"), ("hyp", "")):
        texts = textgrid.long_form(fx.one_side(spark, sf_dir, side))
        path = F.concat(F.lit(f"{root}/{side}/"), folder_of("utt"), F.lit("/"), "utt", F.lit(f"{suffix}.TextGrid"))
        write_files(texts.select(path.alias("path"), F.encode("content", "UTF-8").alias("body")))
    options = EvaluationOptions(audio_dir=f"{root}/audio", ref_dir=f"{root}/ref", hyp_dir=f"{root}/hyp", ref_stem_suffix="-ref")
    store = EvaluationJob(options).run(spark).store
    return store.select("side", "utt", F.col("pos").cast("long").alias("pos"), "phoneme", "start_s", "end_s")


@query(
    "q_annotation_format",
    fx.with_views("hyp_iv")
    + """
    select utt, 'phones' as tier_name, pos, phoneme as label, start_s, end_s from hyp_iv
    union all
    select utt, 'words', 0, 'one "two" 3', 0.0, max(end_s) from hyp_iv group by utt""",
)
def q_annotation_format(spark, sf_dir):
    """Annotation files, written in tasks, listed by levels and read through the format, once for each choice of a tier."""
    root = new_root(spark)
    texts = textgrid.long_form(fx.one_side(spark, sf_dir, "hyp"))
    path = F.concat(F.lit(f"{root}/"), folder_of("utt"), F.lit("/"), "utt", F.lit(".TextGrid"))
    write_files(texts.select(path.alias("path"), F.encode("content", "UTF-8").alias("body")))
    files = stores.list_paths(spark, root)
    utt = F.regexp_extract("path", r"([^/]+)\.TextGrid$", 1).alias("utt")
    parts = [
        formats.read_annotations(spark, files, mode="FAILFAST", **options).select(utt, F.lit(name).alias("tier_name"), F.col("pos").cast("long").alias("pos"), "label", "start_s", "end_s")
        for name, options in (("phones", {}), ("words", {"tierIndex": "0"}))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "q_timeline_format",
    fx.with_views("hyp_iv")
    + """,
    targets as (select distinct utt, phoneme as target from hyp_iv)
    select utt, round(start_s, 4) as start_s, round(end_s - start_s, 4) as duration_s, target,
           case when phoneme = target then 't' else 'f' end as decision
    from hyp_iv join targets using (utt) where end_s - start_s > 0""",
)
def q_timeline_format(spark, sf_dir):
    """Detection timelines written through the format, which commits whole jobs only, and read back."""
    root = new_root(spark)
    formats.write_timeline(iv.etf_rows(fx.one_side(spark, sf_dir, "hyp")), root)
    back = spark.read.format("segmark_etf").load(root)
    return back.withColumns({c: F.round(c, 4) for c in ("start_s", "duration_s")})
