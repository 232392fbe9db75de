"""Sharding: shards of nearly equal bytes, cut from global prefix sums.

Documents are put in the order of their ids, copies of a text right after its first document. Sizes are summed up in
that order from the totals of each task's range, and the sum is cut so that every shard reaches its target. Groups of
equal texts that are large beside a shard are few; they are laid out first, each as one run in the emptiest shard if
one has room for it, else as runs of its copies over as few shards as it takes, and the other documents fill what is
left. Only ids, sizes and digests are moved, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import free_name, given_id, known_id, numbers, running
from segmark.llm.mixing import numbered
from segmark.session import cut

#: What a document takes besides its text.
OVERHEAD = 8
#: A group is large if it takes more than this share of a shard; there are at most shards / LARGE of them.
LARGE = 0.1
PLACED = "doc long, uid long, size long, crc long, shard int, piece int, at long"


def pack(groups: list[tuple[int, int]], shards: int, target: float) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each group (copies, size of one), largest first: its runs (shard, copies), and what each shard then holds.

    A group goes whole to the emptiest shard if that stays within its target and a tenth of it; otherwise the emptiest
    shards take as many copies as they have room for, one at least.
    """
    held, out = [0] * shards, []
    for copies, size in groups:
        runs: list[tuple[int, int]] = []
        while copies:
            best = min(range(shards), key=held.__getitem__)
            fits = copies * size <= (1 + LARGE) * target - held[best]
            n = copies if fits else min(copies, max(1, int((target - held[best]) // size)))
            if runs and runs[-1][0] == best:
                runs[-1] = (best, runs[-1][1] + n)
            else:
                runs.append((best, n))
            held[best] += n * size
            copies -= n
        out.append(runs)
    return out, held


def rooms(held: list[int], rest: int) -> list[float]:
    """What each shard takes of ``rest`` more bytes so that all reach one level, those above it nothing."""
    order, level, below = sorted(held), 0.0, 0
    for k, h in enumerate(order, 1):
        below += h
        level = (rest + below) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - h) for h in held]


def place(rows: DataFrame, shards: int) -> DataFrame:
    """(doc, uid, size, crc, shard, slot) for every row of ``rows`` (doc, uid, size, crc, digest)."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    found = rows.groupBy("digest").agg(F.min(F.struct("doc", "uid")).alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # Written, so that the join deals its sides out itself and Spark can split a text that very many rows have.
    found = cut(found.filter("n > 1").select("digest", "first", "bytes", "n"), "shard-groups")
    large = found.filter(F.col("bytes") > LARGE * target).select("first", "bytes", "n").collect()  # shards / LARGE rows at most
    large.sort(key=lambda r: (-r.bytes, r.first.doc, r.first.uid))
    runs, held = pack([(r.n, r.bytes // r.n) for r in large], shards, target)
    group_of = {r.first.uid: k for k, r in enumerate(large)}

    lead = F.coalesce("first.uid", "uid")
    placed = rows.join(found, "digest", "left").select(
        F.coalesce("first.doc", "doc").alias("lead_doc"), lead.alias("lead_uid"), "doc", "uid", "size", "crc", F.coalesce("bytes", "size").alias("unit"), (F.coalesce("bytes", F.lit(0)) > LARGE * target).alias("large"),
    )
    follows = F.col("uid") != F.col("lead_uid")
    own = F.when(follows | F.col("large"), 0).otherwise(F.col("unit"))
    placed = placed.withColumns({"follows": follows, "weight": own, "one": F.lit(1).cast("long")})
    summed = running(placed, ["lead_doc", "lead_uid", "follows", "doc", "uid"], ["weight", "one"], "shard-sums")
    starts = dict(summed.filter("large and not follows").select("lead_uid", "sum_one").collect())  # one row for each large group
    firsts = {group_of[u]: at for u, at in starts.items()}

    # Cuts of the others' sum, and of the large groups' rows: all bounded by the number of shards.
    room = np.cumsum(rooms(held, total - sum(r.bytes for r in large)))
    pieces = [(firsts[k] + before, shard) for k, own in enumerate(runs) for (shard, n), before in zip(own, np.cumsum([0, *(n for _, n in own)]).tolist())]
    pieces.sort()
    piece_starts, piece_shards = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, uid, size, crc, unit, weight, at = (numbers(b.column(i)) for i in range(7))
            follows, is_large = (np.asarray(b.column(i)) for i in (7, 8))
            # A follower's sum already holds its group, so the group's middle lies half of it before, not after.
            middle = weight + np.where(follows, -unit, unit) / 2
            shard = np.minimum(np.searchsorted(room, middle, side="right"), shards - 1).astype(np.int32)
            piece = np.full(len(doc), -1, np.int32)
            if len(piece_starts):
                own = np.searchsorted(piece_starts, at, side="right") - 1
                shard = np.where(is_large, piece_shards[own], shard).astype(np.int32)
                piece = np.where(is_large, own, piece).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, uid, size, crc, shard, piece, at)], names=[f.split()[0] for f in PLACED.split(", ")])

    dealt = summed.select("doc", "uid", "size", "crc", "unit", "sum_weight", "sum_one", "follows", "large").mapInArrow(deal, PLACED)
    # Rows of large groups stand between the others in the order, so places within a shard are counted anew.
    dealt = dealt.withColumn("inside", (F.col("piece") < 0).cast("long"))
    inner = running(dealt, ["at"], ["inside"], "shard-places")
    inner = inner.withColumn("place", F.when(F.col("piece") < 0, F.col("sum_inside")).otherwise(F.col("at")))
    facts = inner.groupBy("shard", "piece").agg(F.min("place").alias("start"), F.count("*").alias("n")).orderBy("shard", "piece").collect()  # as many as cuts
    bases, last, before = [], None, 0
    for r in facts:
        before = 0 if r.shard != last else before
        bases.append((r.shard, r.piece, before - r.start))
        last, before = r.shard, before + r.n
    base = F.broadcast(spark.createDataFrame(bases, "shard int, piece int, base long"))
    return inner.join(base, ["shard", "piece"]).select("doc", "uid", "size", "crc", "shard", (F.col("place") + F.col("base")).alias("slot"))


def sizes(docs: DataFrame, uid: str) -> DataFrame:
    plain = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(known_id().alias("doc"), F.col(uid).alias("uid"), (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("crc"), F.unhex(F.md5(plain.cast("binary"))).alias("digest"))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``size``: bytes of the text and 8 (a null text has none). Equal texts stay in one shard if one can hold them, and
    otherwise in as few as the others leave room for. A document or small group belongs to the shard that holds its
    middle, so no shard is further from its target than its largest document or a tenth. Rows with one id keep any
    order among them; null ids come last. A document larger than a shard may leave a shard empty. No rows: no rows.
    """
    uid = free_name(docs.columns, "uid")
    rows = cut(sizes(docs.withColumn(uid, F.monotonically_increasing_id()), uid), "shard-sizes")
    return place(rows, shards).select(
        given_id(F.col("doc")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write(docs: DataFrame, folder: str, shards: int = 24) -> str:
    """Writes ``docs`` as Parquet, one folder for each shard, placed as ``assign`` says; gives the shards' column name.

    The column is ``shard``, with underscores added if ``docs`` has one of that name. Every row has a place of its own.
    """
    kept, uid = numbered(docs, docs.columns)
    shard, own = free_name(docs.columns, "shard"), free_name([*docs.columns, uid], "own")
    placed = place(cut(sizes(kept, uid), "shard-sizes"), shards).select(F.col("uid").alias(own), F.col("shard").alias(shard))
    joined = kept.join(placed.hint("shuffle_hash"), kept[uid] == placed[own]).select(*docs.columns, shard)
    joined.write.partitionBy(shard).mode("overwrite").parquet(folder)
    return shard
