"""Label normalisation over interval tables and label sequences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmark.functions import text
from segmark.functions.labels import CustomRules, LabelRules
from segmark.operators.scan import block_width, position_block, with_row_index
from segmark.session import cut

#: Largest label vocabulary (rows, characters) that is broadcast.
MAX_VOCABULARY = 100_000
MAX_VOCABULARY_CHARS = 8_000_000


def normalized(df: DataFrame, column: str, rules: LabelRules, name: str = "phoneme") -> DataFrame:
    """Row-wise normalisation of ``column`` into ``name`` (NULL: not scorable)."""
    composed = df.withColumn("__c", text.compose(column))
    expr = rules.expression(F.col(column), F.col("__c.nfc"), F.col("__c.marks"))
    rest = [c for c in df.columns if c != name]
    return composed.select(*rest, expr.alias(name))


def _small_vocabulary(df: DataFrame, column: str, max_vocabulary: int) -> tuple[DataFrame, bool]:
    """Labels that are few enough to broadcast, and whether they are all: else the most frequent ones that fit."""
    counted = df.select(column).filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # A step in the frequency is a quarter of a doubling, so there are few of them.
    counted = cut(counted.select(column, F.floor(F.log2("n") * 4).cast("int").alias("step")), "labels")
    steps = counted.groupBy("step").agg(F.count("*").alias("n"), F.sum(F.length(column)).alias("chars")).collect()
    n = chars = 0
    least = None
    for s in sorted(steps, key=lambda s: -s["step"]):
        n, chars = n + s["n"], chars + s["chars"]
        if n > max_vocabulary or chars > MAX_VOCABULARY_CHARS:
            kept = F.lit(False) if least is None else F.col("step") >= least
            return counted.filter(kept).select(column), False
        least = s["step"]
    return counted.select(column), True


def normalize_labels(
    df: DataFrame,
    column: str,
    rules: LabelRules,
    name: str = "phoneme",
    max_vocabulary: int = MAX_VOCABULARY,
) -> DataFrame:
    """Normalise a label column of a large table.

    The distinct labels are written first. A small vocabulary (the usual case, checked by rows and
    characters) is normalised once and broadcast; of a larger one the most frequent labels are, and the
    rules run on the rows that hold others in place, so a hot label never gathers in one task either way.
    """
    vocabulary, complete = _small_vocabulary(df, column, max_vocabulary)
    if not complete and isinstance(rules, CustomRules):
        return normalized(df, column, rules, name)
    table = normalized(vocabulary, column, rules, "__out").select(F.col(column).alias("__label"), "__out", F.lit(True).alias("__known"))
    rest = [F.col(c) for c in df.columns if c != name]
    joined = df.join(F.broadcast(table), F.col(column) == F.col("__label"), "left")
    if complete:
        return joined.select(*rest, F.col("__out").alias(name))
    left = joined.withColumn("__left", F.when(F.col("__known").isNull(), F.col(column)))
    done = text.pinned(normalized(left, "__left", rules, "__in"), __in=F.col("__in"))
    return done.select(*rest, F.when(F.col("__known"), F.col("__out")).otherwise(F.col("__in")).alias(name))


def normalize_sides(
    df: DataFrame,
    column: str,
    side: str,
    rules: Mapping[str, LabelRules | CustomRules],
    name: str = "phoneme",
    max_vocabulary: int = MAX_VOCABULARY,
    error: str | None = None,
) -> DataFrame:
    """As :func:`normalize_labels` with one rule set per value of ``side``, over one shared vocabulary.

    With ``error``, a column of that name says why a caller's own rule raised on the label (else NULL); without, what
    such a rule raises ends the job.
    """

    def by_side(outs: Mapping[str, Column], alias: str) -> Column:
        picked = F.lit(None).cast("string")
        for value, out in outs.items():
            picked = F.when(F.col(side) == value, out).otherwise(picked)
        return picked.alias(alias)

    def results(outs: Mapping[str, Column]) -> list[Column]:
        both = [by_side({v: o["value"] for v, o in outs.items()}, name)]
        return both + [by_side({v: o["error"] for v, o in outs.items()}, error)] if error else both

    def outcomes(source: DataFrame, raw: str, kept: list[Column], prefix: str) -> tuple[DataFrame, dict[str, Column]]:
        """``kept`` and the outcome of ``raw`` by each side's rules; outcomes are columns of their own first and pinned, so
        that each function is evaluated once, not again in filters that are pushed down."""
        composed = source.withColumn("__c", text.compose(raw))
        outs: dict[str, Column] = {}
        for value, r in rules.items():
            same = next((outs[v] for v in outs if rules[v] == r), None)
            if same is not None:
                outs[value] = same
            elif error and isinstance(r, CustomRules):
                outs[value] = r.outcome(F.col(raw))
            else:
                plain = r.expression(F.col(raw), F.col("__c.nfc"), F.col("__c.marks"))
                outs[value] = F.struct(plain.alias("value"), F.lit(None).cast("string").alias("error"))
        named = {value: f"{prefix}{next(k for k, v in enumerate(outs) if outs[v] is out)}" for value, out in outs.items()}
        once = {named[value]: out for value, out in outs.items()}
        done = composed.select(*kept, *[out.alias(n) for n, out in once.items()])
        return text.pinned(done, **{n: F.col(n) for n in once}), {v: F.col(n) for v, n in named.items()}

    rest = [F.col(c) for c in df.columns if c != name]
    vocabulary, complete = _small_vocabulary(df, column, max_vocabulary)
    if not complete and not error and any(isinstance(r, CustomRules) for r in rules.values()):
        done, outs = outcomes(df, column, rest, "__in_")
        return done.select(*rest, *results(outs))
    table, outs = outcomes(vocabulary, column, [F.col(column).alias("__label"), F.lit(True).alias("__known")], "__out_")
    joined = df.join(F.broadcast(table), F.col(column) == F.col("__label"), "left")
    if complete:
        return joined.select(*rest, *results(outs))
    left = joined.withColumn("__left", F.when(F.col("__known").isNull(), F.col(column)))
    known = list(dict.fromkeys(c for c in table.columns if c != "__label"))
    done, inside = outcomes(left, "__left", [*rest, *[F.col(c) for c in known]], "__in_")
    return done.select(*rest, *results({v: F.when(F.col("__known"), outs[v]).otherwise(inside[v]) for v in rules}))


def clean_intervals(
    intervals: DataFrame, rules: LabelRules, label: str = "label", renumber: bool = True
) -> DataFrame:
    """Normalise the label of every interval and drop rows whose label vanishes; times untouched.

    Result has ``phoneme`` in place of ``label``. ``pos`` is renumbered densely unless only its order
    matters to the caller.
    """
    out = normalize_labels(intervals, label, rules, "phoneme").filter(F.col("phoneme").isNotNull())
    out = out.drop(label) if label != "phoneme" else out
    if not renumber:
        return out
    keys = [k for k in ("utt", "side") if k in out.columns]
    ordered = out.withColumnRenamed("pos", "__old")
    block = position_block("__old", block_width(intervals, "pos"))
    return with_row_index(ordered, keys, ["__old"], block, "pos").drop("__old")


def normalize_sequence(sequence: Column, composed: Column, rules: LabelRules) -> Column:
    """Normalise a blank-separated label string; labels that vanish are dropped.

    ``composed`` is ``text.compose(sequence)``. Composition never crosses a blank, so the whole string
    is composed at once and the rules run over its tokens without a shuffle.
    """
    marks = composed["marks"]
    out = F.transform(text.tokens(composed["nfc"]), lambda t: rules.expression(t, t, marks))
    return F.when(sequence.isNotNull(), F.array_join(F.filter(out, lambda t: t.isNotNull()), " "))


def normalize_label_list(labels: Column, rules: LabelRules, composed: Column) -> Column:
    """As :func:`normalize_sequence` for an array; ``composed`` is ``compose(array_join(labels, NUL))``."""
    parts = F.when(F.size(labels) == 0, F.array().cast("array<string>")).otherwise(
        F.split(composed["nfc"], "\x00")
    )
    out = F.transform(parts, lambda t: rules.expression(t, t, composed["marks"]))
    return F.filter(out, lambda t: t.isNotNull())
