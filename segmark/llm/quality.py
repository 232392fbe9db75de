"""Quality rules: a decision list learned from labelled document statistics.

Statistics of whole texts are taken in tasks. A bounded sample of labelled documents is brought to the driver as
numbers; sequential covering grows one conjunction of thresholds after another on two thirds of them and prunes
it on the rest; the list becomes one ordered ``CASE WHEN`` that Spark evaluates on every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmark.llm.common import free_name, known_id, text_rows

#: What is counted in each text; the first five are those of the base rules.
COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_top n_upper n_digits n_stops".split()
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".!?"
#: Statistics the rules may test, as (name, numerator, denominator).
RATIOS = [
    ("word_length", "word_chars", "n_words"), ("symbols", "n_symbols", "word_chars"), ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"), ("line_words", "n_words", "n_lines"), ("distinct", "n_distinct", "n_words"),
    ("top_word", "n_top", "n_words"), ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"), ("stops", "n_stops", "n_words"),
]


def repeat_words(words: list, width: int = 5) -> int:
    """Words covered by windows of ``width`` words that are found twice or more."""
    windows = len(words) - width + 1
    if windows < 2:
        return 0
    seen: dict = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    keys, kinds = codes, len(seen)
    for k in range(1, width):  # equal keys: equal first k + 1 words
        distinct, keys, found = np.unique(keys[:-1] * kinds + codes[k:], return_inverse=True, return_counts=True)
        if len(distinct) == len(keys):
            return 0
    again = found[keys] > 1
    change = np.zeros(len(words) + 1, np.int64)
    change[:windows] += again
    change[width : width + windows] -= again
    return int((np.cumsum(change[:-1]) > 0).sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0)
    words, lines = text.split(), text.split(b"\n")
    full = [x for x in lines if x.strip()]
    dense = text.translate(None, SPACE)
    kinds = Counter(words)
    gone = lambda chars: len(dense) - len(dense.translate(None, chars))
    return (
        len(words), len(dense.decode("utf-8", "replace")), gone(SYMBOLS), len(full) - len(set(full)), repeat_words(words),
        len(lines), len(kinds), max(kinds.values(), default=0), gone(UPPER), gone(DIGITS), gone(STOPS),
    )


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``COUNTS``, and that column's name (one that ``docs`` doesn't have).

    Words are runs of anything but blank, tab and the line controls. A null text counts like an empty one.
    """
    name = free_name(docs.columns, "counts")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(at)]
            columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
            struct = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, struct], names=[f.name for f in schema.fields])

    return text_rows(docs).mapInArrow(add, schema), name


def ratio(counts: str, top: str, bottom: str) -> Column:
    value = lambda c: F.col(f"`{counts}`").getField(c)
    return value(top) / F.greatest(value(bottom), F.lit(1))


def base_failed(counts: str) -> Column:
    """Fewer than ten words, or more than a fifth of the words in repeated windows."""
    value = lambda c: F.col(f"`{counts}`").getField(c)
    return (value("n_words") < 10) | (100 * value("n_repeat_words") > 20 * value("n_words"))


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.bound if self.above else x[:, self.feature] <= self.bound


@dataclass(frozen=True)
class RuleOptions:
    """``sample``: labelled documents that the fit looks at, at most (the ones with the smallest id hashes)."""

    sample: int = 20_000
    thresholds: int = 64
    most_tests: int = 4
    most_rules: int = 24
    least_covered: int = 5
    precision: float = 0.95


def covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in rule:
        hit &= t.holds(x)
    return hit


def grow(x: np.ndarray, bad: np.ndarray, options: RuleOptions) -> list[Test]:
    """Adds the test with the highest information gain until no good row is covered or nothing is gained."""
    rule: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(rule) < options.most_tests and (~bad[inside]).any() and bad[inside].any():
        rows, flags = x[inside], bad[inside]
        now, best, choice = np.log2(flags.mean()), 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            values, below = rows[order, f], np.cumsum(flags[order])
            ends = np.flatnonzero(np.append(values[1:] != values[:-1], False))
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, options.thresholds).astype(int))] if len(ends) else ends
            for above in (False, True):
                n = len(values) - ends - 1 if above else ends + 1
                p = below[-1] - below[ends] if above else below[ends]
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - now), 0)
                if len(gain) and gain.max() > best:
                    k = int(gain.argmax())
                    best, choice = gain[k], Test(f, above, float((values[ends[k]] + values[ends[k] + 1]) / 2))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.holds(x)
    return rule


def prune(rule: list[Test], x: np.ndarray, bad: np.ndarray) -> list[Test]:
    """The beginning of the rule that does best on rows it was not grown on; the longer one on a tie."""
    def worth(k: int) -> float:
        hit = covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), k))] if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, options: RuleOptions = RuleOptions()) -> list[list[Test]]:
    """Sequential covering: rules for bad rows, in order, until a rule isn't precise enough. No rows: no rules."""
    rules: list[list[Test]] = []
    held = np.arange(len(x)) % 3 == 2
    while bad.any() and (~bad).any() and len(rules) < options.most_rules:
        rule = prune(grow(x[~held], bad[~held], options), x[held], bad[held])
        hit = covers(rule, x)
        if not rule or (hit & bad).sum() < options.least_covered or bad[hit].mean() < options.precision:
            break
        rules.append(rule)
        x, bad, held = x[~hit], bad[~hit], held[~hit]
    return rules


def expression(rules: list[list[Test]], counts: str) -> Column:
    """False for documents that a rule describes, else true: one ordered conditional."""
    verdict = None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            value = ratio(counts, *RATIOS[t.feature][1:])
            test = test & (value > t.bound if t.above else value <= t.bound)
        verdict = F.when(test, False) if verdict is None else verdict.when(test, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, options: RuleOptions = RuleOptions()) -> list[list[Test]]:
    """The decision list for ``quality`` = 0 against 1 (other and null labels take no part).

    A document labelled twice has its lower label. The sample is the same on every run; only its figures reach
    the driver. Documents that fail the base rules are not learned from: the list judges the others.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc"), "doc").limit(options.sample)
    own = docs.select(known_id().alias("doc"), "text").join(F.broadcast(chosen), "doc")  # no more than `sample` rows
    counted, counts = with_counts(own)
    features = F.array(*(ratio(counts, *r[1:]) for r in RATIOS))
    rows = counted.filter(~base_failed(counts)).groupBy("doc").agg(F.min(F.struct(features.alias("x"), "quality")).alias("r"))
    found = sorted(rows.select(F.xxhash64("doc").alias("h"), "doc", "r.x", "r.quality").collect())
    x = np.array([r.x for r in found], float).reshape(-1, len(RATIOS))
    return learn(x, np.array([r.quality == 0 for r in found], bool), options)


def judge(docs: DataFrame, rules: list[list[Test]]) -> tuple[DataFrame, str]:
    """All columns and rows of ``docs`` with a struct of the counts, ``base_failed`` and ``kept``, and its name."""
    counted, counts = with_counts(docs)
    verdict = F.struct(f"`{counts}`.*", base_failed(counts).alias("base_failed"), (~base_failed(counts) & expression(rules, counts)).alias("kept"))
    return counted.withColumn(counts, verdict), counts
