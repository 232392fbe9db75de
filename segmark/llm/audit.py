"""Which filter removes what, for every order of the filters, by min-plus products.

A document fails some of the filters; documents are counted by part and by the set of filters they fail, so what is left
has a row for each part and set. A part's sets are the rows of a mask matrix with 0 where a filter fails and infinity
where it passes. Another matrix has the place of each filter in each order (the inverse permutations). Their min-plus
product is the step that removes a set of failures under an order: the smallest place among the filters it fails.
Counts are added up at those steps; what fails a filter at a later step is redundant there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import known_id, numbers, text_rows
from segmark.session import cut

FILTERS = "ABCDE"
#: The bits of the filters that look at one text; E looks at the whole table.
A, B, C, D, E = (1 << k for k in range(5))
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Bytes that go on with a character of UTF-8.
GOING_ON = bytes(range(0x80, 0xC0))
NEVER = 1 << 20
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def fails(text: bytes) -> int:
    """The bits of A to D for a text, on the whole of it."""
    words = text.split()  # at ASCII white space
    points = len(text.translate(None, GOING_ON))
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        A * (len(words) < 100)
        | B * (100 * len(set(words)) < 80 * len(words))
        | C * (100 * upper > 10 * points)
        | D * (len(text) > len(text.translate(None, SIGNS)))
    )


def failed(docs: DataFrame) -> DataFrame:
    """(doc, part, fails) for every row: the bits of A to E."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [fails(x.as_buffer().to_pybytes()) for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bits, pa.int32())], names=["doc", "part", "one", "two", "fails"])

    # Two hashes stand for a text: 128 bits tell the texts of any corpus apart.
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = known_id().alias("doc"), F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"), text.alias("text")
    own = cut(text_rows(docs, *columns).mapInArrow(rows, "doc long, part string, one long, two long, fails int"), "audit-fails")
    groups = own.groupBy("one", "two").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    groups = cut(groups.filter("first <> last").select("one", "two", "first"), "audit-copies")
    copy = F.when(F.col("doc") > F.col("first"), F.lit(E)).otherwise(F.lit(0))  # no group: not a copy
    return own.join(groups, ["one", "two"], "left").select("doc", "part", F.col("fails").bitwiseOR(copy).alias("fails"))


def orders() -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and (filters, orders): the place of each filter in each order, from 0."""
    names = ["".join(p) for p in permutations(FILTERS)]
    return names, np.array([[n.index(f) for n in names] for f in FILTERS])


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(masks, orders): the min-plus product, NEVER where nothing fails."""
    cost = np.where(masks[:, None] >> np.arange(len(FILTERS)) & 1, 0, NEVER)
    return np.minimum((cost[:, :, None] + places[None]).min(axis=1), NEVER)


def part_counts(masks: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(orders, steps, 7) counts of COUNTS for one part. ``counts``: (masks, 3) rows, good and toxic rows."""
    steps = removal_steps(masks, places)
    n_filters, n_orders = places.shape
    out = np.zeros((n_orders, n_filters, len(COUNTS)), np.int64)
    at = np.argsort(places, axis=0)  # the filter at each step of each order
    order = np.arange(n_orders)
    scattered = np.zeros((n_orders, n_filters, 3), np.int64)
    for step, own in zip(steps, counts):
        gone = step < NEVER
        scattered[order[gone], step[gone]] += own
    out[:, :, 1], out[:, :, 4], out[:, :, 5] = scattered[:, :, 0], scattered[:, :, 1], scattered[:, :, 2]
    out[:, :, 0] = counts[:, 0].sum() - np.cumsum(scattered[:, :, 0], axis=1)
    for mask, step, (n, _, _) in zip(masks.tolist(), steps, counts.tolist()):
        for f in range(n_filters):
            if mask >> f & 1:
                late = places[f] > step
                out[order[late], places[f][late], 2] += n
                if mask == 1 << f:
                    out[order, places[f], 3] += n
    removed = scattered[order[None], places, 0].sum(axis=1)  # of each filter, over all orders
    out[:, :, 6] = removed[at].T
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``docs`` (doc_id, text, lang), ``labels`` (doc_id, quality, toxic). A part for each lang (null: the empty string),
    in it all 120 orders of the filters A to E and 5 steps, zeros included. A null text is empty; a null id comes after
    all others and has no label. Repeated rows count each; those of one id and text are no copies of each other.
    Several labels of one id count as good or toxic if any is. No documents: no rows.
    """
    rows = cut(failed(docs), "audit-rows")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("bad")
    )
    marks = cut(marks.filter("good + bad > 0"), "audit-labels")
    lost = rows.join(marks, "doc").groupBy("part", "fails").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    all_ = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))
    by_set = all_.union(lost).groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    by_part = by_set.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "bad")).alias("sets"))  # 32 at most

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = orders()
        for b in batches:
            for part, sets in zip(b.column(0), b.column(1)):
                masks, *counts = (numbers(c) for c in sets.values.flatten())
                table = part_counts(masks, np.stack(counts, 1), places).reshape(-1, len(COUNTS))
                steps = len(FILTERS)
                columns = [pa.array([part.as_py()] * len(table), pa.string()), pa.array(np.repeat(names, steps).tolist()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(rank, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


AUDIT_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), failing as (
  select doc_id, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c,
         regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e from texts
), sets as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n,
         count(*) filter (where doc_id in (select doc_id from labels where quality = 1)) as good,
         count(*) filter (where doc_id in (select doc_id from labels where toxic = 1)) as bad
  from failing group by all
), filters as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as f(filter, bit)
), orders as (
  select a.filter || b.filter || c.filter || d.filter || e.filter as filter_order
  from filters a, filters b, filters c, filters d, filters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31
    and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps as (
  select filter_order, s::int as step, substr(filter_order, s::int, 1) as filter from orders, generate_series(1, 5) g(s)
), placed as (select * from steps join filters using (filter)),
removal as (
  select part, mask, n, good, bad, filter_order, min(step) filter (where (mask & bit) > 0) as gone
  from sets, placed group by all
), counted as (
  select part, filter_order, step, filter,
         coalesce(sum(n) filter (where gone is null or gone > step), 0)::bigint as kept,
         coalesce(sum(n) filter (where gone = step), 0)::bigint as removed,
         coalesce(sum(n) filter (where gone < step and (mask & bit) > 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (where gone = step), 0)::bigint as good_lost,
         coalesce(sum(bad) filter (where gone = step), 0)::bigint as toxic_lost
  from removal join placed using (filter_order) group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, filter))::bigint as shapley
from counted
"""
