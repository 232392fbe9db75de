"""File listings: stems, pairing of audio with annotation, groups, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmark.functions import text
from segmark.sources import stores

# Fixed values.
AUDIO_EXTENSIONS = (".wav", ".flac", ".mp3", ".ogg", ".m4a")
TEXTGRID_EXTENSIONS = (".TextGrid", ".textgrid")
DEFAULT_GROUP = "ALL"


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Paths under a folder, hidden ones too; contents are not read."""
    return stores.list_paths(spark, folder, recursive)


def strip_stem_suffix(stem: Column, suffix: str | None) -> Column:
    if not suffix:
        return stem
    cut_at = F.length(stem) - len(suffix)
    return F.when(F.endswith(stem, F.lit(suffix)), F.substring(stem, F.lit(1), cut_at)).otherwise(stem)


def index_by_stem(
    files: DataFrame, extensions: Sequence[str], stem_suffix: str | None = None, recursive: bool = True
) -> DataFrame:
    """One path per stem (stem, path).

    Extensions are case-insensitive; hidden files and notebook checkpoint folders are skipped. A file
    whose stem carries the suffix beats one that does not, then the first path in part order wins.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    bare = F.when(ext != "", F.substring(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    wanted = [e.lower() for e in extensions]
    usable = (
        ~F.startswith(name, F.lit("."))
        & ~F.array_contains(parts, ".ipynb_checkpoints")
        & F.lower(ext).isin(*wanted)
    )
    stem = strip_stem_suffix(bare, stem_suffix)
    rows = files.filter(usable).select(
        stem.alias("stem"), (stem == bare).alias("plain"), parts.alias("parts"), "path"
    )
    # A minimum combines before the shuffle, so a stem shared by very many files stays cheap.
    best = F.min(F.struct("plain", "parts", "path"))
    return rows.groupBy("stem").agg(best.alias("b")).select("stem", F.col("b.path").alias("path"))


def discover_pairs(
    audio: DataFrame, refs: DataFrame, hyps: DataFrame | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """Pair indexed files by stem, driven by the references.

    ``reason`` is NULL for samples, else why the stem is skipped.
    """
    joined = refs.select("stem", F.col("path").alias("ref_path")).join(
        audio.select("stem", F.col("path").alias("audio_path")), "stem", "left"
    )
    # The reasons.
    excluded = F.col("stem").isin(*exclude) if exclude else F.lit(False)
    reason = F.when(excluded, "excluded").when(F.col("audio_path").isNull(), "no audio file")
    hyp_path = F.lit(None).cast("string").alias("hyp_path")
    if hyps is not None:
        joined = joined.join(hyps.select("stem", F.col("path").alias("hyp_path")), "stem", "left")
        reason = reason.when(F.col("hyp_path").isNull(), "no hypothesis TextGrid")
        hyp_path = F.col("hyp_path")
    return joined.select("stem", "audio_path", "ref_path", hyp_path, reason.alias("reason"))


def samples(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("reason").isNull()).drop("reason")


def skipped(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("reason").isNotNull()).select("stem", "reason")


def limit_samples(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` samples in stem order; None or 0 keeps all."""
    return rows.orderBy("stem").limit(limit) if limit else rows


def group_map(rows: DataFrame, key: str = "file", value: str = "style") -> DataFrame:
    """Group lines (line_no, <key>, <value>) to one group per key: the last line wins."""
    for column in (key, value):
        if column not in rows.columns:
            raise KeyError(f"column {column!r} not in {rows.columns}")
    k = text.strip(F.coalesce(F.col(key), F.lit("")))
    v = text.strip(F.coalesce(F.col(value), F.lit("")))
    cleaned = rows.select("line_no", k.alias("key"), F.when(v == "", DEFAULT_GROUP).otherwise(v).alias("group"))
    return cleaned.filter(F.col("key") != "").groupBy("key").agg(F.max_by("group", "line_no").alias("group"))


def assign_groups(rows: DataFrame, groups: DataFrame, default: str = DEFAULT_GROUP) -> DataFrame:
    """Attach ``group`` by stem, else by audio file name, else the default; ``matched`` tells which."""
    named = rows.withColumn("__name", F.element_at(F.split("audio_path", "/"), -1))
    by_stem = groups.select(F.col("key").alias("stem"), F.col("group").alias("__g1"))
    by_name = groups.select(F.col("key").alias("__name"), F.col("group").alias("__g2"))
    found = F.coalesce("__g1", "__g2")
    return (
        named.join(by_stem, "stem", "left")
        .join(by_name, "__name", "left")
        .select(*rows.columns, F.coalesce(found, F.lit(default)).alias("group"), found.isNotNull().alias("matched"))
    )


def run_summary(pairs: DataFrame, evaluated: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts of a run: evaluated, failed, and skipped per reason."""
    return (
        pairs.filter(F.col("reason").isNotNull())
        .groupBy(F.concat(F.lit("skipped: "), "reason").alias("what"))
        .agg(F.count("*").alias("n"))
        .unionByName(evaluated.agg(F.count("*").alias("n")).select(F.lit("evaluated").alias("what"), "n"))
        .unionByName(failures.agg(F.count("*").alias("n")).select(F.lit("failed").alias("what"), "n"))
    )
