"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmark.session import cut

#: Stands for a null document id, so that it sorts last.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def given_id(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Texts that Spark hands to a Python worker at once.
TEXT_ROWS = 1000


def text_rows(df: DataFrame, *columns) -> DataFrame:
    """``df`` (its ``columns``) for a function of Arrow batches over texts.

    A batch of Spark's usual 10,000 rows would hold tens of MB of text several times over, in the JVM and in the
    worker; the session's batch size is lowered, never raised.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df.select(*columns) if columns else df


def free_name(taken: Sequence[str], wish: str) -> str:
    """``wish``, with underscores added until no column has that name (names compare without case)."""
    low = {x.lower() for x in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A numeric Arrow column without nulls as a numpy array."""
    return column.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs ``start, start + 1, ...`` one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return skip + np.arange(total)


def running(df: DataFrame, order: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``sum_<v>``: the total of each long column ``v`` over all rows before this one in ``order``.

    Rows are dealt out by range and sorted; each task adds up its own rows and the totals of the tasks (one
    row each) are added afterwards, so no task ever holds more than its range. ``order`` must tell all rows
    apart for the result to be the same on every run.
    """
    spark = df.sparkSession
    schema = T.StructType(
        [*df.schema.fields, *(T.StructField(f"sum_{v}", T.LongType()) for v in values), T.StructField("part", T.IntegerType())]
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), [0] * len(values)
        for b in batches:
            columns = list(b.columns)
            for i, v in enumerate(values):
                own = numbers(b.column(b.schema.get_field_index(v)))
                total = np.cumsum(own)
                columns.append(pa.array(before[i] + total - own))
                before[i] += int(total[-1]) if len(total) else 0
            columns.append(pa.array(np.full(b.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    local = cut(ranged.mapInArrow(add, schema), name)
    totals = local.groupBy("part").agg(*(F.sum(v).alias(v) for v in values)).orderBy("part").collect()
    bases, sums = [], [0] * len(values)
    for row in totals:  # one row for each task
        bases.append((row["part"], *sums))
        sums = [s + row[v] for s, v in zip(sums, values)]
    base = spark.createDataFrame(bases, "part int, " + ", ".join(f"base_{v} long" for v in values))
    out = local.join(F.broadcast(base), "part")
    return out.select(*df.columns, *((F.col(f"sum_{v}") + F.col(f"base_{v}")).alias(f"sum_{v}") for v in values))


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, root), root the smallest node reachable.

    Each round hangs every node under the smallest node among its neighbours (large star), then pulls links of
    smaller neighbours to the smallest one (small star), until each component is a star. A round moves no more
    than a constant number of rows for each edge, minima are combined before the shuffle and each round's links
    are written to the shared folder. Works on any orientation and repetition of links.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut(links, name)
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.filter("u <> v").distinct(), name)
        mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark(after) == mark(links):
            break
        links = after
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of each text (empty ones removed), and how many each text has."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    real = numbers(pc.binary_length(flat)) > 0
    if real.all():
        return flat, np.diff(offsets)
    return flat.filter(pa.array(real)), np.diff(np.append(0, np.cumsum(real))[offsets])


def kept_in_worker(key: tuple, make: Callable):
    """What ``make`` gives, made once for each Python worker; it outlives the task, unlike a shipped module's globals."""
    store = sys.modules.setdefault("_segmark_worker", types.ModuleType("_segmark_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
