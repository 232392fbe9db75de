"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of times it should be taken: ``min(2, exp(l_s * size / mean size))``, the
rates closest to 1 in relative entropy for which every source's words meet its target. The multipliers ``l_s``
solve the convex dual; every Newton step is one aggregation over all documents. The constraints of different
sources have no document in common, so the Hessian is diagonal and a step solves all sources at once. Rates are
then rounded to copies by running sums, which keeps the error of a source below its largest document, and a few
single copies are moved to come closer still.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import free_name, given_id, known_id, running
from segmark.session import cut

WEIGHTS = (3, 1, 2)
#: Rates are held as whole numbers of 2**-24, so that sums don't depend on their order.
BITS = 24
UNIT = 1 << BITS


@dataclass(frozen=True)
class MixOptions:
    """``most_sources``: figures of so many sources may come to the driver; more are refused."""

    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5
    most: int = 2
    tolerance: float = 1e-7
    most_steps: int = 60
    repairs: int = 6
    most_sources: int = 100_000


def waterfill(sizes: list[int], options: MixOptions) -> list[float]:
    """Targets by weight, none above ``most`` times its source, the excess dealt out again among the others."""
    weights = [options.weights[i % len(options.weights)] for i in range(len(sizes))]
    caps = [float(options.most * s) for s in sizes]
    targets, rest, open_ = [0.0] * len(sizes), options.share * sum(sizes), set(range(len(sizes)))
    while open_:
        share = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * share >= caps[i]}
        for i in full or open_:
            targets[i] = caps[i] if full else weights[i] * share
        if not full:
            break
        rest -= sum(caps[i] for i in full)
        open_ -= full
    return targets


class Dual:
    """One source's multiplier on its way to the root: Newton, kept between the ends known so far."""

    def __init__(self, target: float, size: int, most: int):
        self.target, self.at, self.low, self.high = target, 0.0, -math.inf, math.inf
        self.done = size == 0
        if not self.done and target >= most * size * (1 - 1e-12):
            self.at, self.done = math.inf, True
        if not self.done and target <= 0:
            self.at, self.done = -math.inf, True

    def step(self, words: float, slope: float, tolerance: float) -> None:
        if self.done or abs(words - self.target) <= tolerance * self.target:
            self.done = True
            return
        if words < self.target:
            self.low = self.at
        else:
            self.high = self.at
        change = (self.target - words) / slope if slope > 0 else math.copysign(4.0, self.target - words)
        after = self.at + max(-4.0 * (1 + abs(self.at)), min(4.0 * (1 + abs(self.at)), change))
        if not self.low < after < self.high:
            after = (self.low + self.high) / 2
        self.done = after == self.at
        self.at = after


def taken(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(uid, doc_id, source, size, source_size, target, copies) for every row of ``docs`` (uid, doc_id, source, text).

    ``size``: runs of anything but ASCII white space (null text: 0). Sources are weighed in the order of their
    code points, null last as a source of its own. No document is taken more than ``most`` times, one without
    words as its rate says. Ties and repeated rows are told apart by ``uid``, which must stay the same on a rerun
    for equal results. No rows: no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = cut(docs.select("uid", known_id().alias("doc"), "source", size.alias("size")), "mix-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(options.most_sources + 1).collect()
    if len(found) > options.most_sources:
        raise ValueError(f"more than {options.most_sources} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r["size"]) for r in found]
    targets = waterfill(sizes, options) if found else []
    means = [max(s, 1) / r.n for s, r in zip(sizes, found)]
    duals = [Dual(t, s, options.most) for t, s in zip(targets, sizes)]

    def per_source(**columns) -> DataFrame:
        kinds = {"source": "string", "s": "int", "mean": "double", "at": "double", "source_size": "long", "target": "double", "gap": "long"}
        data = [(r.source, i, *(c[i] for c in columns.values())) for i, r in enumerate(found)]
        return F.broadcast(spark.createDataFrame(data, ", ".join(f"{k} {kinds[k]}" for k in ("source", "s", *columns))).withColumnRenamed("source", "of"))

    same = F.col("source").eqNullSafe(F.col("of"))
    tilt = F.col("at") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(options.most)), F.exp(F.least(tilt, F.lit(50.0)))))
    for _ in range(options.most_steps):
        if all(d.done for d in duals):
            break
        here = rows.join(per_source(mean=means, at=[d.at for d in duals]), same).select("s", "size", "mean", rate.alias("rate"))
        free = F.when(F.col("rate") < options.most, F.col("size") * F.col("size") * F.col("rate") / F.col("mean")).otherwise(0.0)
        for r in here.groupBy("s").agg(F.sum(F.col("size") * F.col("rate")).alias("words"), F.sum(free).alias("slope")).collect():
            duals[r.s].step(r.words, r.slope, options.tolerance)

    # Nine digits of the multipliers: what is beyond depends on the order of the sums.
    ats = [d.at if math.isinf(d.at) else float(f"{d.at:.9g}") for d in duals]
    rated = rows.join(per_source(mean=means, at=ats, source_size=sizes, target=targets), same)
    rated = rated.select("uid", "doc", "source", "s", "size", "source_size", "target", F.round(rate * UNIT).cast("long").alias("units"), (-F.col("size")).alias("down"))
    if not found:
        return rated.select("uid", given_id(F.col("doc")).alias("doc_id"), "source", "size", "source_size", "target", F.lit(0).alias("copies"))
    summed = running(rated, ["s", "down", "doc", "uid"], ["units"], "mix-rates")
    copies = (F.shiftright(F.col("sum_units") + F.col("units"), BITS) - F.shiftright("sum_units", BITS)).cast("int")
    rounded = cut(summed.withColumn("copies", copies), "mix-copies")

    gaps = {r.s: round(targets[r.s] - r.words) for r in rounded.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).collect()}
    moved: dict[int, int] = {}  # of each source, one document for each repair at most
    for _ in range(options.repairs):
        more = F.col("gap") > 0
        able = (F.col("size") > 0) & (2 * F.abs("gap") > F.col("size")) & F.when(more, F.col("copies") < options.most).otherwise(F.col("copies") > 0)
        left = rounded.join(per_source(gap=[gaps.get(i, 0) for i in range(len(found))]).drop("of"), "s").filter(able & (F.col("gap") != 0))
        if moved:
            left = left.join(F.broadcast(spark.createDataFrame([(u,) for u in moved], "uid long")), "uid", "left_anti")
        best = left.groupBy("s").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("off"), "doc", "uid", "size")).alias("b")).collect()
        for r in best:
            sign = 1 if gaps[r.s] > 0 else -1
            moved[r.b.uid] = sign
            gaps[r.s] -= sign * r.b["size"]
        if not best:
            break
    change = F.broadcast(spark.createDataFrame(list(moved.items()), "uid long, change int"))
    final = rounded.join(change, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return final.select("uid", given_id(F.col("doc")).alias("doc_id"), "source", "size", "source_size", "target", "copies")


def numbered(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """``columns`` of ``docs`` written once with a row number, so that every later read has the same numbers."""
    uid = free_name(columns, "uid")
    return cut(docs.select(*columns).withColumn(uid, F.monotonically_increasing_id()), "mix-docs"), uid


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it (see ``taken``)."""
    kept, uid = numbered(docs, docs.columns)
    plan = taken(kept.select(F.col(uid).alias("uid"), "doc_id", "source", "text"), options).filter("copies > 0").select(F.col("uid").alias(uid), "copies")
    copies = free_name(kept.columns, "copies")
    times = kept.join(plan.withColumnRenamed("copies", copies).hint("shuffle_hash"), uid)
    return times.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
