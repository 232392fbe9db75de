"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task, which is right while all
values fit one. Beyond, wanted ranks are found digit by digit, as in a radix sort that follows one bucket
only: the bits of a double, seen as an integer, order as the values do, so a histogram of their first digit
tells which bucket holds a rank, one of the next digit inside that bucket narrows it, and so on until the
bucket holds one value. Histograms combine before they shuffle, so what travels depends on the number of
buckets and never on the number of values; the values are written once and scanned once a digit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmark.session import cut

#: Values (over all groups) up to which the built-in percentile is used.
MAX_IN_TASK = 2_000_000
#: Largest table of buckets to follow that is broadcast.
MAX_TARGETS = 100_000
#: Bits of a digit: a wanted rank reads at most 2 ** DIGIT buckets in one task.
DIGIT = 16
_BITS = 64


def exact_quantiles(
    rows: DataFrame,
    grain: Sequence[str],
    value: str,
    wanted: Mapping[str, tuple[Column, float]],
    at_most: int | None = None,
    max_in_task: int = MAX_IN_TASK,
    digit: int = DIGIT,
) -> DataFrame:
    """Linearly interpolated quantiles per grain.

    ``rows`` holds values, each as often as it likes; ``wanted`` maps an output name to a weight expression
    (how often the row counts in that list, 0 when it does not) and a probability. ``at_most`` is a known
    bound on ``rows``; without one they are written and counted first. Null values count in no list, and a list
    without values gives NULL. Rows with a null grain are a group as any other.
    """
    probs = {n: p for n, (_, p) in wanted.items()}
    weights = [w.cast("long").alias(f"w_{n}") for n, (w, _) in wanted.items()]
    table = rows.select(*grain, value, *weights)
    if at_most is None or at_most > max_in_task:
        table = cut(_with_bits(table, value), "values")
        at_most = at_most or table.count()
    if at_most <= max_in_task:
        return table.groupBy(*grain).agg(
            *[F.percentile(value, p, F.col(f"w_{n}")).alias(n) for n, p in probs.items()]
        )
    return _by_digits(table, list(grain), value, probs, digit)


def _with_bits(table: DataFrame, value: str) -> DataFrame:
    """``bits``: a long that orders as the value does (both zeros are one)."""
    v = F.col(value).cast("double") + F.lit(0.0)
    raw = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(v, F.lit(0.0))).cast("long")
    below = F.lit((1 << 63) - 1)
    return table.withColumn("raw", raw).withColumn(
        "bits", F.when(F.col(value).isNull(), None).when(F.col("raw") < 0, F.col("raw").bitwiseXOR(below)).otherwise(F.col("raw"))
    ).drop("raw")


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns], F.lit(True))


def _histogram(rows: DataFrame, grain: list[str], value: str, probs: Mapping[str, float], done: int, digit: int) -> DataFrame:
    """(grain, prefix, cell, name, p, w, least, most): the buckets of the next digit, by list."""
    prefix = F.lit(0).cast("long") if done == 0 else F.shiftright("bits", _BITS - done)
    keyed = rows.withColumn("prefix", prefix).withColumn("cell", F.shiftright("bits", max(0, _BITS - done - digit)))
    counts = [F.sum(f"w_{n}").alias(f"w_{n}") for n in probs]
    ends = [f(F.when(F.col(f"w_{n}") > 0, F.col(value))).alias(f"{e}_{n}") for n in probs for e, f in (("least", F.min), ("most", F.max))]
    buckets = keyed.groupBy(*grain, "prefix", "cell").agg(*counts, *ends)
    lists = [
        F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"), F.col(f"w_{n}").alias("w"), F.col(f"least_{n}").alias("least"), F.col(f"most_{n}").alias("most"))
        for n, p in probs.items()
    ]
    return buckets.select(*grain, "prefix", "cell", F.inline(F.array(*lists)))


def _narrowed(histogram: DataFrame, ranks: DataFrame, grain: list[str]) -> DataFrame:
    """Each wanted rank with the bucket that holds it and its rank in there."""
    keys = [*grain, "name", "prefix"]
    cells = histogram.filter("w > 0")
    met = cells.join(ranks, _same(cells, ranks, keys)).select(*[cells[c] for c in keys], "cell", "w", "least", "most", "high", "h", "rank")
    # The cells of one bucket: 2 ** digit at most.
    upto = Window.partitionBy(*keys, "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("before", F.sum("w").over(upto) - F.col("w"))
    here = met.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("w")))
    return here.select(
        *grain, "name", "high", "h", F.col("cell").alias("prefix"), (F.col("rank") - F.col("before")).alias("rank"), "least", "most"
    )


def _by_digits(table: DataFrame, grain: list[str], value: str, probs: Mapping[str, float], digit: int) -> DataFrame:
    known = table.filter("bits is not null")
    histogram = cut(_histogram(known, grain, value, probs, 0, digit), "digit")
    totals = histogram.groupBy(*grain, "name", "p").agg(F.sum("w").alias("t")).filter("t > 0")
    ranks = totals.withColumn("h", (F.col("t") - 1) * F.col("p")).select(
        *grain, "name", F.lit(0).cast("long").alias("prefix"), "h", F.explode(F.array(F.lit(False), F.lit(True))).alias("high")
    )
    ranks = ranks.withColumn("rank", F.when(F.col("high"), F.ceil("h")).otherwise(F.floor("h")).cast("long"))
    found: list[DataFrame] = []
    for done in range(0, _BITS, digit):
        if done:
            wanted = ranks.select(*grain, "prefix").distinct()
            if wanted.count() <= MAX_TARGETS:
                wanted = F.broadcast(wanted)
            rows = known.withColumn("prefix", F.shiftright("bits", _BITS - done))
            rows = rows.join(wanted, _same(rows, wanted, [*grain, "prefix"]), "left_semi").drop("prefix")
            histogram = _histogram(rows, grain, value, probs, done, digit)
        step = cut(_narrowed(histogram, ranks, grain), "ranks")
        found.append(step.filter("least = most"))
        ranks = step.filter("least < most").drop("least", "most")
        if ranks.isEmpty():
            break
    picked = reduce(DataFrame.unionByName, found)

    def at(n: str, high: bool) -> Column:
        return F.max(F.when((F.col("name") == n) & (F.col("high") == high), F.col("least")))

    ends = picked.groupBy(*grain).agg(
        *[c for n in probs for c in (at(n, False).alias(f"a_{n}"), at(n, True).alias(f"b_{n}"), F.max(F.when(F.col("name") == n, F.col("h"))).alias(f"h_{n}"))]
    )
    groups = table.select(*grain).distinct()
    part = lambda n: F.col(f"h_{n}") - F.floor(f"h_{n}")
    return groups.join(ends, _same(groups, ends, grain), "left").select(
        *[groups[c] for c in grain], *[(F.col(f"a_{n}") + (F.col(f"b_{n}") - F.col(f"a_{n}")) * part(n)).alias(n) for n in probs]
    )
