"""Exact top-k search by inner product: KD-trees per shard, best-first, with the kth score handed on.

Vectors are scaled to whole numbers and dealt out to shards of bounded size. A task builds a shard's tree by median
splits along the widest side and keeps tight boxes. A query visits the leaves in the order of the largest score
that a box allows and stops where it falls below its kth best. Each query first searches one shard; the kth score
found there goes with it to all others, where boxes that cannot reach it fall away. Vectors and queries move as
single rows and a shard's tree is built once, so a task holds one shard at a time.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import numbers, partitions
from segmark.session import cut

#: Sums of products up to here are exact as doubles, and as 64-bit integers; beyond, Python's integers are used.
DOUBLES, LONGS = 2**53, 2**63
#: Queries whose bounds a task takes together.
BLOCK = 256


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with null or non-finite components are left out.

    A scaled component that no 64-bit integer holds is an error.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    fits = lambda c: F.abs(c * scale) < float(LONGS)
    held = F.transform(x, lambda c: F.when(fits(c), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("long")))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("v"))


class Tree:
    """Nodes in arrays: bounds of all vectors below, children, and each leaf's rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int):
        self.low, self.high, self.kids, self.rows = [], [], [], []
        stack = [(np.argsort(ids, kind="stable"), -1)]
        while stack:
            rows, parent = stack.pop()
            own = len(self.low)
            if parent >= 0:
                self.kids[parent].append(own)
            part = x[rows]
            self.low.append(part.min(axis=0))
            self.high.append(part.max(axis=0))
            self.kids.append([])
            wide = self.high[-1] - self.low[-1]
            if len(rows) <= leaf or not wide.any():  # equal vectors need no split
                self.rows.append(rows)
                continue
            self.rows.append(None)
            axis = int(wide.argmax())
            order = rows[np.argsort(x[rows, axis], kind="stable")]
            stack += [(order[: len(order) // 2], own), (order[len(order) // 2 :], own)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.x = ids, x
        self.peak = max(abs(int(self.low.min())), abs(int(self.high.max())))
        self.others: dict = {x.dtype: self}

    def exact(self, q: np.ndarray) -> "Tree":
        """This tree with numbers in which the products of ``q`` (whole numbers) with its vectors are exact."""
        most = self.peak * max(abs(int(q.min())), abs(int(q.max()))) * q.shape[1]
        kind = np.dtype(float if most < DOUBLES else np.int64 if most < LONGS else object)
        if kind not in self.others:
            own = copy.copy(self)
            own.low, own.high, own.x = self.low.astype(kind), self.high.astype(kind), self.x.astype(kind)
            self.others[kind] = own
        return self.others[kind]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product that its box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, own: int, q: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple]:
        """The best (score, -id), best first; nothing below ``floor``, which k known candidates reach."""
        best: list[tuple] = []  # heap with the worst on top
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < max(floor, best[0][0] if len(best) == k else -np.inf):
                break
            if self.rows[node] is None:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.x[rows] @ q
            least = max(floor, best[0][0] if len(best) == k else -np.inf)
            fit = np.flatnonzero((scores >= least) & (self.ids[rows] != own))
            if len(fit) > k:
                by = np.argsort(self.ids[rows[fit]], kind="stable")
                fit = fit[by[np.argsort(-scores[fit[by]], kind="stable")[:k]]]
            for s, i in zip(scores[fit].tolist(), self.ids[rows[fit]].tolist()):
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
        return sorted(best, reverse=True)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = 8192, leaf: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each row of ``queries`` but its own id.

    Both tables are (vec_id, embedding). Equal scores: smaller id first; fewer candidates than ``k``: all of them.
    Only vectors of the query's length are candidates. Rows with a null id, vector or component, or with one that
    isn't finite, take no part; scores are exact, and one beyond 64 bits is an error. Repeated rows are repeated
    candidates, a query repeated with one id and vector counts once. Every query goes to every shard, as an exact
    search over vectors without structure must; larger ``shard_rows`` mean fewer copies of the queries.
    """
    spark = queries.sparkSession
    base = whole_vectors(vectors, scale).withColumns({"d": F.size("v"), "uid": F.monotonically_increasing_id()})
    base = cut(base.filter("d > 0"), "knn-vectors")
    counts = base.groupBy("d").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shards = cut(counts, "knn-shards")  # one row for each length of vectors
    own = base.join(shards, "d").withColumn("shard", F.pmod(F.xxhash64("vec_id", "uid"), "shards").cast("int"))
    asked = whole_vectors(queries, scale).distinct().withColumn("d", F.size("v")).join(shards, "d")
    home = F.pmod(F.xxhash64("vec_id"), "shards").cast("int")
    asked = cut(asked.withColumn("home", home), "knn-queries")
    by = ["d", "shard", "kind"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree = None, [], None
        for b in batches:
            keys = np.stack([numbers(b.column(i)) for i in range(3)], 1)
            edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for first, last in zip(edges, [*edges[1:], len(keys)]):
                d, shard, kind = keys[first].tolist()
                ids = numbers(b.column(3))[first:last]
                x = np.asarray(b.column(4).slice(first, last - first).flatten()).astype(np.int64).reshape(-1, d)
                if at != (d, shard):
                    at, parts, tree = (d, shard), [], None
                if not kind:  # a shard's vectors come before the queries that are sent to it
                    parts.append((ids, x))
                    continue
                if tree is None:
                    held, rows = (np.concatenate(c) for c in zip(*parts))
                    parts = []
                    tree = Tree(held, rows, leaf)
                floors = b.column(5).slice(first, last - first).to_pylist()
                for j in range(0, len(ids), BLOCK):
                    own = tree.exact(x[j : j + BLOCK])
                    q, out = x[j : j + BLOCK].astype(own.x.dtype), []
                    for own_id, own_q, bound, floor in zip(ids[j : j + BLOCK].tolist(), q, own.bounds(q), floors[j : j + BLOCK]):
                        best = own.search(own_id, own_q, bound, k, -np.inf if floor is None else floor)
                        out += [(own_id, -minus, int(score)) for score, minus in best]
                    columns = list(zip(*out)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def run(sent: DataFrame) -> DataFrame:
        """``sent``: (d, shard, vec_id, v, floor) of the queries that a shard gets."""
        columns = [*by, "vec_id", "v", "floor"]
        rows = own.withColumns({"kind": F.lit(0), "floor": F.lit(None).cast("long")}).select(*columns).union(sent.withColumn("kind", F.lit(1)).select(*columns))
        dealt = rows.repartition(partitions(spark), "d", "shard").sortWithinPartitions(*by, "vec_id")
        return dealt.mapInArrow(search, "query_id long, vec_id long, score long")

    first = cut(run(asked.withColumns({"shard": F.col("home"), "floor": F.lit(None).cast("long")})), "knn-first")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = kth.select("vec_id", F.try_element_at("s", F.lit(k)).alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("home"))
    rest = asked.join(kth, "vec_id", "left").withColumn("shard", F.explode(others))
    both = first.union(run(rest))
    # Each shard gives k rows for a query at most.
    lists = both.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best"))
    out = lists.select("query_id", F.posexplode("best").alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.down")).alias("score"))
