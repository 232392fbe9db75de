"""The evaluation run: pair, read, normalise, re-anchor, validate, store, score, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmark.functions.labels import CustomRules, LabelRules, build_rules
from segmark.operators import intervals as iv
from segmark.operators import metrics, seqalign
from segmark.operators.frames import CtcOptions, ctc_align, ctc_options, fixed_chunks, whole_file_chunks
from segmark.operators.labels import normalize_sides
from segmark.operators.large import join_facts
from segmark.operators.vad import vad_chunks
from segmark.session import cut, spread
from segmark.sources import audio, manifest, reports, runstore, tables, textgrid

#: A wrong tier name or label table is wrong for every file: this many first samples must not all fail.
FAIL_FAST_AFTER = 3


@dataclass(frozen=True)
class EvaluationOptions:
    """Everything a run can be told."""

    audio_dir: str = ""
    ref_dir: str = ""
    hyp_dir: str | None = None
    out_dir: str | None = None
    audio_stem_suffix: str | None = None
    ref_stem_suffix: str | None = None
    hyp_stem_suffix: str | None = None
    exclude: Sequence[str] = ()
    limit: int | None = None
    groups_csv: str | None = None
    group_key: str = "file"
    group_value: str = "style"
    ref_tier: textgrid.TierChoice = textgrid.TierChoice()
    hyp_tier: textgrid.TierChoice = textgrid.TierChoice()
    ref_preset: str = "none"
    hyp_preset: str = "none"
    ref_mapping: Mapping[str, str] | str | None = None
    hyp_mapping: Mapping[str, str] | str | None = None
    ref_rules: LabelRules | CustomRules | None = None
    hyp_rules: LabelRules | CustomRules | None = None
    ref_offset: str = "auto"
    ref_offset_tolerance: float = 0.5
    hypothesis: str = "textgrid"
    model: str = "wav2vec2"
    decoder: str = "forced_align"
    end_mode: str = "span"
    chunking: str = "none"
    chunk_seconds: float = 30.0
    scoring: metrics.ScoreOptions = field(default_factory=metrics.ScoreOptions)
    per_phoneme: bool = False
    etf: bool = False
    tag: str | None = None

    def __post_init__(self) -> None:
        if self.hypothesis not in ("textgrid", "ctc"):
            raise ValueError(f"hypothesis must be textgrid or ctc, got {self.hypothesis!r}")
        if self.ref_offset not in ("auto", "force", "never"):
            raise ValueError(f"ref_offset must be auto, force or never, got {self.ref_offset!r}")
        if self.decoder not in ("forced_align", "greedy"):
            raise ValueError(f"decoder must be forced_align or greedy, got {self.decoder!r}")
        if self.chunking not in ("none", "vad", "fixed"):
            raise ValueError(f"chunking must be none, vad or fixed, got {self.chunking!r}")


@dataclass(frozen=True)
class Evaluation:
    """Tables of a finished run."""

    store: DataFrame
    failures: DataFrame
    predictions: DataFrame
    scored: metrics.Scored
    #: Of runs over folders: stems left out with a reason, stems without a group, counts of all outcomes.
    skipped: DataFrame | None = None
    ungrouped: DataFrame | None = None
    summary: DataFrame | None = None

    @property
    def report(self) -> DataFrame:
        return metrics.report(self.scored)

    @property
    def per_phoneme(self) -> DataFrame:
        return metrics.per_phoneme(self.scored)

    @property
    def inventory(self) -> DataFrame:
        return metrics.inventory(self.store)


def _mapping(spark: SparkSession, given: Mapping[str, str] | str | None) -> Mapping[str, str] | None:
    return tables.read_label_map(spark, given) if isinstance(given, str) else given


class Store(NamedTuple):
    """Intervals ready for scoring, failed recordings, the longest side of a recording, and the recordings (utt) that
    the intervals are of."""

    intervals: DataFrame
    failures: DataFrame
    longest: int
    recordings: DataFrame


def build_store(
    samples: DataFrame, ref: DataFrame, hyp: DataFrame, durations: DataFrame | None, options: EvaluationOptions
) -> Store:
    """Normalise, re-anchor and validate raw intervals of both sides.

    ``samples`` is (utt, file, style); raw intervals are (utt, pos, label, start_s, end_s). A recording
    whose labels all vanish on one side, or with a label on which a caller's own rule raises, fails with a
    reason and leaves the store.
    """
    spark = samples.sparkSession
    rules = {
        "ref": options.ref_rules or build_rules(options.ref_preset, _mapping(spark, options.ref_mapping)),
        "hyp": options.hyp_rules or build_rules(options.hyp_preset, _mapping(spark, options.hyp_mapping)),
    }
    names = ["utt", "pos", "label", "start_s", "end_s"]
    both = ref.select(F.lit("ref").alias("side"), *names).unionByName(hyp.select(F.lit("hyp").alias("side"), *names))
    named = normalize_sides(both, "label", "side", rules, error="why").drop("label")
    custom = any(isinstance(r, CustomRules) for r in rules.values())
    cleaned = named.filter(F.col("phoneme").isNotNull())
    scorable = F.col("phoneme").isNotNull()
    seen = named.filter(scorable | F.col("why").isNotNull()) if custom else cleaned
    # One pass per recording gives what validation, re-anchoring and the length check need.
    ref_pos = F.when((F.col("side") == "ref") & scorable, F.col("pos"))
    facts = seen.groupBy("utt").agg(
        F.count_if((F.col("side") == "ref") & scorable).alias("n_ref"),
        F.count_if((F.col("side") == "hyp") & scorable).alias("n_hyp"),
        # A minimum of texts is found by sorting: only where a rule can raise.
        (F.min("why") if custom else F.lit(None).cast("string")).alias("why"),
        F.min_by("start_s", ref_pos).alias("first_s"),
        F.max_by("end_s", ref_pos).alias("last_s"),
    )
    rows = samples.join(facts, "utt", "left")
    # Re-anchoring comes after normalisation: the first interval that was kept gives the offset.
    if options.ref_offset == "force":
        shift = F.col("first_s")
    elif options.ref_offset == "never" or durations is None:
        shift = F.lit(0.0)
    else:
        rows = rows.join(durations.select("utt", "duration_s"), "utt", "left")
        late = F.col("last_s") > F.col("duration_s") + options.ref_offset_tolerance
        shift = F.when(late, F.col("first_s")).otherwise(0.0)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_ref", "n_hyp")]
    checked = cut(rows.select("utt", "file", "style", *counts, shift.alias("shift"), "why"), "checked")
    good = (F.col("n_ref") > 0) & (F.col("n_hyp") > 0) & F.col("why").isNull()
    bare = F.format_string("no label is left to score: %d in the reference, %d in the hypothesis", "n_ref", "n_hyp")
    failures = checked.filter(~good).select("utt", F.coalesce("why", bare).alias("reason"))
    longest = checked.agg(F.max(F.greatest("n_ref", "n_hyp"))).first()[0] or 0
    moved = F.when(F.col("side") == "ref", F.col("shift")).otherwise(0.0)
    limit = options.scoring.max_one_task
    is_long = F.greatest("n_ref", "n_hyp") > limit
    intervals = join_facts(cleaned.drop("why"), checked.filter(good), is_long, longest, limit).select(
        "utt",
        "file",
        "style",
        "side",
        "pos",
        "phoneme",
        (F.col("start_s") - moved).alias("start_s"),
        (F.col("end_s") - moved).alias("end_s"),
    )
    return Store(intervals, failures, longest, checked.filter(good).select("utt").distinct())


def evaluate_tables(
    samples: DataFrame,
    ref: DataFrame,
    hyp: DataFrame,
    durations: DataFrame | None,
    options: EvaluationOptions,
    predictions: DataFrame | None = None,
    read_failures: DataFrame | None = None,
    aligner: seqalign.Aligner = seqalign.align_labels,
) -> Evaluation:
    """Score raw interval tables. Predictions default to the raw hypothesis labels, as read."""
    store, failures, longest, _ = build_store(samples, ref, hyp, durations, options)
    if read_failures is not None:
        # A file that could not be read explains an empty side better than the emptiness does.
        first = read_failures.groupBy("utt").agg(F.min("reason").alias("why"))
        failures = failures.join(first, "utt", "left").select("utt", F.coalesce("why", "reason").alias("reason"))
    if predictions is None:
        predictions = iv.phoneme_strings(hyp.withColumnRenamed("label", "phoneme"))
    # Written once: scoring, inventory and timeline all read the stored rows.
    store, failures = cut(store, "store"), cut(failures, "failures")
    scored = metrics.score(store, options.scoring, longest=longest, aligner=aligner)
    if scored.failures is not None:  # recordings on which the caller's aligner raised leave the store, as others do
        store = store.join(scored.failures.select("utt"), "utt", "left_anti")
        failures = failures.unionByName(scored.failures)
    return Evaluation(store, failures, predictions, scored)


def rescore(spark: SparkSession, path: str, scoring: metrics.ScoreOptions) -> DataFrame:
    """Report of a stored run under other tolerances or another cap."""
    run = runstore.read_split(spark, path)
    if scoring.max_one_task == run.limit:
        return metrics.report(metrics.score(run.short, scoring, longest=run.longest, parts=(run.short, run.long)))
    return metrics.report(metrics.score(runstore.read_store(spark, path), scoring, longest=run.longest))


def make_chunks(
    kind: str, seconds: float, durations: DataFrame, vad: DataFrame | None = None
) -> DataFrame:
    """Chunk table by kind: none (whole recording), fixed windows, or speech activity."""
    if kind == "none":
        return whole_file_chunks(durations)
    if kind == "fixed":
        return fixed_chunks(durations, seconds)
    if vad is None:
        raise ValueError("speech-activity chunking needs a score table")
    return vad_chunks(vad, seconds)


def ctc_hypothesis(
    frames: DataFrame, chunks: DataFrame, durations: DataFrame, vocab: DataFrame, options: CtcOptions
) -> tuple[DataFrame, DataFrame]:
    """(raw hypothesis intervals, label strings) from posteriors."""
    intervals, strings = ctc_align(frames, chunks, durations, vocab, options)
    return intervals.withColumnRenamed("phoneme", "label"), strings


@dataclass(frozen=True)
class EvaluationJob:
    """A run over folders. For posteriors as hypothesis give ``frames``, ``vocab`` (and ``vad``) tables,
    keyed by stem; ``unk_id`` comes with the CTC options."""

    options: EvaluationOptions
    frames: DataFrame | None = None
    vocab: DataFrame | None = None
    vad: DataFrame | None = None
    chunks: DataFrame | None = None
    ctc: CtcOptions | None = None
    #: Known lengths (utt, duration_s); headers are read for the other recordings only.
    durations: DataFrame | None = None
    aligner: seqalign.Aligner = seqalign.align_labels

    def pairs(self, spark: SparkSession) -> DataFrame:
        o = self.options
        audio_files = manifest.index_by_stem(
            manifest.list_files(spark, o.audio_dir), manifest.AUDIO_EXTENSIONS, o.audio_stem_suffix
        )
        refs = manifest.index_by_stem(
            manifest.list_files(spark, o.ref_dir), manifest.TEXTGRID_EXTENSIONS, o.ref_stem_suffix
        )
        hyps = None
        if o.hypothesis == "textgrid":
            if not o.hyp_dir:
                raise ValueError("a textgrid hypothesis needs hyp_dir")
            hyps = manifest.index_by_stem(
                manifest.list_files(spark, o.hyp_dir), manifest.TEXTGRID_EXTENSIONS, o.hyp_stem_suffix
            )
        return manifest.discover_pairs(audio_files, refs, hyps, o.exclude)

    def _samples(self, spark: SparkSession, pairs: DataFrame) -> DataFrame:
        o = self.options
        rows = manifest.limit_samples(manifest.samples(pairs), o.limit)
        if o.groups_csv:
            lines = tables.read_group_rows(spark, o.groups_csv)
            rows = manifest.assign_groups(rows, manifest.group_map(lines, o.group_key, o.group_value))
        else:
            rows = rows.withColumns({"group": F.lit(manifest.DEFAULT_GROUP), "matched": F.lit(True)})
        name = F.element_at(F.split("audio_path", "/"), -1)
        return rows.withColumn("utt", F.col("stem")).withColumn("file", name).withColumnRenamed("group", "style")

    def _read(self, rows: DataFrame, column: str, choice: textgrid.TierChoice):
        texts = textgrid.read_paths(rows.select("utt", F.col(column).alias("path")))
        found = textgrid.tiers(texts, rename_duplicates=choice.rename_duplicates)
        # Written once: failures, vocabulary, checks and store all read the intervals, none the token streams.
        return textgrid.read_intervals(found, choice, write=True)

    def _evaluate(self, spark: SparkSession, rows: DataFrame) -> Evaluation:
        o = self.options
        ref, bad_ref = self._read(rows, "ref_path", o.ref_tier)
        paths = rows.select("utt", F.col("audio_path").alias("path"))
        given = None
        if self.durations is not None:
            given = paths.join(self.durations.select("utt", "duration_s"), "utt").select("utt", F.col("duration_s").cast("double").alias("duration_s"), F.lit(None).cast("string").alias("error"))
            paths = paths.join(self.durations.select("utt"), "utt", "left_anti")
        lengths = paths.join(audio.durations(spread(paths)), "path").select("utt", "duration_s", "error")
        lengths = cut(lengths if given is None else lengths.unionByName(given), "durations")
        failures = bad_ref.select(F.col("utt"), "reason")
        if o.ref_offset == "auto" or o.hypothesis == "ctc":
            bad_audio = lengths.filter(F.col("error").isNotNull()).select("utt", F.col("error").alias("reason"))
            failures = failures.unionByName(bad_audio)
            ref = ref.join(bad_audio.select("utt"), "utt", "left_anti")
        durations = lengths.filter(F.col("duration_s").isNotNull()).select("utt", "duration_s")
        predictions = None
        if o.hypothesis == "textgrid":
            hyp, bad_hyp = self._read(rows, "hyp_path", o.hyp_tier)
            failures = failures.unionByName(bad_hyp)
        else:
            if self.frames is None or self.vocab is None:
                raise ValueError("a ctc hypothesis needs frames and vocab tables")
            # Samples only: a limit or the preflight must not read all posteriors.
            wanted = rows.select("utt")
            frames, vad, chunks = (t if t is None else t.join(wanted, "utt", "left_semi") for t in (self.frames, self.vad, self.chunks))
            if chunks is None:
                chunks = make_chunks(o.chunking, o.chunk_seconds, durations, vad)
            ctc = self.ctc or ctc_options(o.model, decoder=o.decoder, end_mode=o.end_mode)
            hyp, predictions = ctc_hypothesis(frames, chunks, durations, self.vocab, ctc)
        return evaluate_tables(
            rows.select("utt", "file", "style"), ref, hyp, durations, o, predictions, failures, self.aligner
        )

    def preflight(self, spark: SparkSession, rows: DataFrame) -> None:
        """Stop early when the first samples all fail."""
        first = cut(rows.orderBy("utt").limit(FAIL_FAST_AFTER), "preflight")
        n = first.count()
        failed = self._evaluate(spark, first).failures
        if n == FAIL_FAST_AFTER and failed.count() == n:
            row = failed.orderBy(F.desc("utt")).first()
            raise RuntimeError(
                f"no recording of the first {n} could be evaluated ({row['utt']}: {row['reason']}); "
                "look at the tier choice and at whether the annotation can be read"
            )

    def run(self, spark: SparkSession) -> Evaluation:
        pairs = cut(self.pairs(spark), "pairs")
        rows = cut(self._samples(spark, pairs), "samples")
        if rows.isEmpty():
            raise RuntimeError("no audio/reference pairs found; check the folders and the stem suffixes")
        self.preflight(spark, rows)
        result = self._evaluate(spark, rows)
        if result.scored.files.isEmpty():
            raise RuntimeError("nothing could be evaluated; see the failures table")
        result = replace(
            result,
            skipped=manifest.skipped(pairs),
            ungrouped=rows.filter(~F.col("matched")).select("stem"),
            summary=manifest.run_summary(pairs, result.scored.files, result.failures),
        )
        if self.options.out_dir:
            self.write(result)
        return result

    def write(self, result: Evaluation) -> None:
        o = self.options
        tag = o.tag or (o.model if o.hypothesis == "ctc" else "textgrid")
        base = o.out_dir.rstrip("/")
        runstore.write_store(result.store, f"{base}/alignment_{tag}")
        for name in ("failures", "skipped", "ungrouped", "summary"):
            if (table := getattr(result, name)) is not None:
                table.write.mode("overwrite").parquet(f"{base}/{name}_{tag}")
        reports.write_inventory(result.inventory, f"{base}/inventory_{tag}.txt")
        kept = result.scored.files.select("utt")
        reports.write_phoneme_strings(
            result.predictions.join(kept, "utt", "left_semi"), f"{base}/predictions_{tag}.csv"
        )
        reports.write_metrics(result.report, f"{base}/metrics_{tag}.csv", o.scoring.tags)
        if o.per_phoneme:
            reports.write_per_phoneme(result.per_phoneme, f"{base}/per_phoneme_{tag}.csv")
        if o.etf:
            hyp = result.store.filter(F.col("side") == "hyp")
            reports.write_etf(iv.etf_rows(hyp), f"{base}/hyp_{tag}.etf")
