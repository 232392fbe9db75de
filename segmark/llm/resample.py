"""Importance resampling towards a target: array-scored weights, then exact ranks by regular sampling.

The features of a text are its runs of one to three words, hashed into buckets by CRC-32. Each word's checksum is worked
out once, and those of longer runs are put together from them, as a checksum is linear over GF(2). Counts by bucket of
the corpus and of the target give each bucket's gain (one number for each bucket reaches the driver, none for each
document), and a text's weight is the sum of the gains of its features.

Documents are ranked by sorting with regular samples: every task sorts its run and gives rows at equal distances, those
of all runs give the splitters, the pieces of the runs between two splitters meet in one task and are merged there, and
the counts of the segments before it turn a row's place into its rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmark.llm.common import given_id, known_id, numbers, partitions, text_rows
from segmark.session import cut

BUCKETS, LONGEST_RUN = 10_000, 3
#: Words up to this many bytes are hashed side by side, longer ones one by one.
SHORT = 64
#: Rows that the runs give as samples to the driver, at most (one for each run at least).
SAMPLES = 1_000_000
_BYTES = np.arange(256, dtype=np.uint8)
#: Of each byte: whether it belongs to a word. Digits, letters and everything beyond ASCII do.
IN_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = bytes(range(256)).lower()


def crc_table() -> np.ndarray:
    """What one more byte does to each low byte of a running CRC-32 (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


class Checksums:
    """CRC-32 of many byte strings at once, and of strings put together from two."""

    def __init__(self):
        self.table = crc_table()
        one = np.array([1 << k for k in range(32)], np.uint32)  # images of the single bits
        byte = self.table[one & 255] ^ (one >> 8)
        near, step = [one], one
        for _ in range(SHORT + 1):
            step = self._apply(byte, step)
            near.append(step)
        self.near = np.stack([self._spread(s) for s in near])  # [length, byte of the checksum, its value]
        self.far = [byte]  # for 1, 2, 4, ... zero bytes
        for _ in range(31):
            self.far.append(self._apply(self.far[-1], self.far[-1]))
        self.far = np.stack([self._spread(s) for s in self.far])

    @staticmethod
    def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for k in range(32):
            out ^= np.where((x >> np.uint32(k)) & 1, images[k], 0).astype(np.uint32)
        return out

    @classmethod
    def _spread(cls, images: np.ndarray) -> np.ndarray:
        return np.stack([cls._apply(images, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])

    def shift(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Checksums as they enter that of the string followed by ``lengths`` further bytes."""
        out = self._through(self.near, np.minimum(lengths, SHORT + 1), crc)
        far = np.flatnonzero(lengths > SHORT + 1)
        if len(far):
            own, left = crc[far], lengths[far]
            for k in range(int(left.max()).bit_length()):
                on = np.flatnonzero(left >> k & 1)
                own[on] = self._through(self.far, np.full(len(on), k), own[on])
            out[far] = own
        return out

    @staticmethod
    def _through(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[which, 0, crc & 255] ^ tables[which, 1, crc >> 8 & 255] ^ tables[which, 2, crc >> 16 & 255] ^ tables[which, 3, crc >> 24]

    def of(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Checksum of each string ``raw[start : start + length]``."""
        out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        order = np.argsort(-np.where(lengths > SHORT, 0, lengths), kind="stable")  # long strings last
        at, left = starts[order], np.where(lengths > SHORT, 0, lengths)[order]
        value = out[order]
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k, side="left"))  # strings of more than k bytes
            value[:n] = self.table[(value[:n] ^ raw[at[:n] + k]) & 255] ^ (value[:n] >> 8)
        out[order] = ~value
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = zlib.crc32(raw[starts[i] : starts[i] + lengths[i]])
        return out


_SUMS: list[Checksums] = []


def features(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and the buckets of all features, text after text."""
    if not _SUMS:
        _SUMS.append(Checksums())
    sums = _SUMS[0]
    rows = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts]
    raw = np.frombuffer(b" ".join([*rows, b""]).translate(LOWER), np.uint8)
    inside = np.concatenate(([False], IN_WORD[raw], [False])).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(r) + 1 for r in rows]) if rows else np.zeros(0, np.int64)
    text = np.searchsorted(ends, starts, side="right")
    words = np.bincount(text, minlength=len(rows))
    own = sums.of(raw, starts, lengths)
    blank = sums.shift(np.full(len(own), zlib.crc32(b" "), np.uint32), lengths) ^ own  # of a blank and the word
    texts_of, hashes, run = [text], [own], own
    for k in range(1, longest):
        run = sums.shift(run[:-1], lengths[k:] + 1) ^ blank[k:] if len(run) else run
        whole = text[k:] == text[: max(len(text) - k, 0)]
        texts_of.append(text[k:][whole])
        hashes.append(run[whole])
    where = np.concatenate(texts_of)
    order = np.argsort(where, kind="stable")
    return words, np.bincount(where, minlength=len(rows)), (np.concatenate(hashes)[order] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all ``texts`` (one column) fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(features(b.column(0), buckets, longest)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = text_rows(texts).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, counts taken one larger."""
    corpus_all, target_all = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    pairs = zip(target.tolist(), corpus.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * corpus_all / ((s + 1) * target_all))) for t, s in pairs], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc, n_words, n_features, weight) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, found = features(b.column(1), len(sent.value), longest)
            total = np.append(0, np.cumsum(sent.value[found]))
            ends = np.append(0, np.cumsum(n))
            columns = [b.column(0), *(pa.array(np.asarray(c, np.int64)) for c in (words, n, np.diff(total[ends])))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_features", "weight"])

    return text_rows(docs, known_id().alias("doc"), "text").mapInArrow(rows, "doc long, n_words long, n_features long, weight long")


def regular_ranks(rows: DataFrame, order: list[str], rank: str, segments: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """``rows`` with their place (from 1) in the order of the long columns ``order``, which must tell all rows apart.

    The driver gets ``samples`` rows of the order's columns at most, one more for each run, and a count for each segment.
    With p runs and s samples a segment holds its share and p / s of all rows at most, however the values lie.
    """
    spark = rows.sparkSession
    segments = segments or partitions(spark)
    stride = max(1, -(-rows.count() // max(1, min(samples, rows.rdd.getNumPartitions() * segments))))

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0  # of the run that this task has sorted
        for b in batches:
            yield b.take(pa.array(np.arange(-at % stride, b.num_rows, stride)))
            at += b.num_rows

    keys = T.StructType([T.StructField(c, T.LongType()) for c in order])
    found = rows.select(*order).sortWithinPartitions(*order).mapInArrow(regular, keys).toArrow()
    found = np.stack([c.to_numpy() for c in found.columns], 1)
    found = found[np.lexsort(found.T[::-1])]
    splitters = found[np.unique((np.arange(1, segments) * len(found)) // segments)] if len(found) else found
    sent = spark.sparkContext.broadcast(splitters)  # one row fewer than segments at most
    where = [rows.columns.index(c) for c in order]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.stack([numbers(b.column(i)) for i in where], 1)
            both = np.concatenate([own, sent.value])
            place = np.empty(len(both), np.int64)  # a row equal to a splitter comes after it
            place[np.lexsort((np.append(np.ones(len(own)), np.zeros(len(sent.value))), *both.T[::-1]))] = np.arange(len(both))
            segment = np.searchsorted(place[len(own) :], place[: len(own)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment.astype(np.int32))], names=[*b.schema.names, "segment"])

    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("segment", T.IntegerType())]))
    merged = dealt.repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = -1, 0
        for b in batches:
            segment = numbers(b.column(b.schema.get_field_index("segment")))
            new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.zeros(0, np.int64)
            place = np.arange(len(segment)) - np.repeat(new, np.diff(np.append(new, len(segment))))
            if len(segment):
                if segment[0] == at:
                    place[: new[1] if len(new) > 1 else len(segment)] += n
                at, n = int(segment[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])

    placed = merged.mapInArrow(count, T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())]))
    placed = cut(placed, "resample-segments")
    before, at = [], 0
    for r in placed.groupBy("segment").agg(F.count("*").alias("n")).orderBy("segment").collect():  # one row for each segment
        before.append((r.segment, at))
        at += r.n
    base = F.broadcast(spark.createDataFrame(before, "segment int, before long"))
    return placed.join(base, "segment").select(*rows.columns, (F.col("before") + F.col("place") + 1).alias(rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``; ``target`` has the texts to be like.

    Words are digits, letters and what is beyond ASCII, in whole texts with A-Z in lower case (null: none); features are
    all runs of up to ``longest`` of them. ``score`` adds Gumbel noise from the id (a null id: from no digits) to the
    weight, both in thousandths and rounded down. Of the documents with ``least_words`` words or more, ``percent`` in a
    hundred (rounded down) with the highest scores are drawn; ``rank`` counts them from 1, others have none. Ties go to
    the smaller id, null ids last; rows with one id and score come in any order. A ``target`` without features gives
    every bucket its share of the corpus alone. No rows: no rows.
    """
    texts = docs.select("text")
    gain = gains(bucket_counts(texts, buckets, longest), bucket_counts(target.select("text"), buckets, longest))
    weighed = weigh(docs, gain, longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(given_id(F.col("doc")).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumns({"down": -F.col("score"), "uid": F.monotonically_increasing_id()})
    scored = cut(scored, "resample-scores")  # the row numbers stay
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = regular_ranks(able, ["down", "doc", "uid"], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.union(rest).select(given_id(F.col("doc")).alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")
