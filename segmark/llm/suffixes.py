"""Suffix-array dedup: bytes inside any string of a given length that starts more than once go.

The corpus is never sorted as a whole. Every window of ``length`` bytes is put under the smallest hash of the short
strings inside it, so equal windows have one key and neighbours mostly share theirs: a text falls into runs of
windows under one key. Runs whose key occurs once are done with. The others' texts are brought together by key,
equal ones once with their number, and a suffix array of each key's texts, built by linear grouping (``lyndon``), has
equal windows side by side; a key with one text that occurs several times needs no array. Keys with more than ``most``
bytes of distinct text are not sorted; their windows are counted one by one by a 128-bit hash, which spreads them over
all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import given_id, known_id, numbers, partitions
from segmark.llm.lyndon import suffix_orders
from segmark.session import cut

LENGTH, GRAM, MOST = 200, 64, 8192
#: Bytes of text that a task gathers before it sorts, and symbols sorted together.
GATHERED, TOGETHER = 1 << 22, 1 << 20
#: Low bits of a short string's hash that give way to its place, so that of equal hashes the leftmost is the smallest.
PLACE = 12
RUN = "key long, seg long, doc long, tag long, lo int, n int"


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows: key, first window, number of windows.

    A window's key is its smallest hash of ``gram`` bytes, a run the neighbours that have it at one place. Of several
    such places in a window the leftmost counts, so equal windows, wherever they stand, are always of different runs:
    a key that occurs once has no repeated window. Texts are worked on in pieces, which may part a run but no key.
    """
    width, found = length - gram + 1, []
    windows, step = len(raw) - length + 1, (1 << PLACE) - width + 1
    symbols = np.frombuffer(raw, np.uint8)
    for at in range(0, windows, step):
        with np.errstate(over="ignore"):
            hashes = symbols[at : min(at + step, windows) + length - 1] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
            power, size = np.uint64(0x9E3779B97F4A7C15), 1
            while size < gram:  # gram is a power of 2
                hashes = hashes[:-size] * power + hashes[size:]
                power, size = power * power, 2 * size
            hashes ^= hashes >> np.uint64(31)
            hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes &= ~np.uint64((1 << PLACE) - 1)
        low = least(hashes | np.arange(len(hashes), dtype=np.uint64), width)
        first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        found.append(((low[first] >> np.uint64(PLACE)).astype(np.int64), first + at, np.diff(np.append(first, len(low)))))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def run_rows(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Keys with how often they occur in each batch, and the runs of all texts."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(x.as_buffer().to_pybytes(), length, gram)[0] for x in b.column(0) if x.is_valid]
            distinct, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64))], names=["key", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                parts = []
                for doc, tag, x in zip(numbers(b.column(0))[k : k + 1000], numbers(b.column(1))[k : k + 1000], b.column(2)[k : k + 1000]):
                    raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                    key, lo, n = runs(raw, length, gram)
                    if len(key):
                        seg = np.array([xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(lo.tolist(), (lo + n + length - 1).tolist())], np.uint64).view(np.int64)
                        parts.append((key, seg, np.full(len(key), doc), np.full(len(key), tag), lo, n))
                if parts:
                    columns = [np.concatenate(c) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:4]] + [pa.array(c.astype(np.int32)) for c in columns[4:]], names=[f.split()[0] for f in RUN.split(", ")])

    return docs.select("text").mapInArrow(keys, "key long, n long"), docs.select(known_id().alias("doc"), F.xxhash64("text").alias("tag"), "text").mapInArrow(rows, RUN)


def packed(docs: DataFrame) -> DataFrame:
    """(doc, tag, raw): texts compressed, for the shuffle."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            raw = [squeeze.compress(x.as_buffer().to_pybytes()) if x.is_valid else squeeze.compress(b"") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["doc", "tag", "raw"])

    return docs.select(known_id().alias("doc"), F.xxhash64("text").alias("tag"), "text").mapInArrow(pack, "doc long, tag long, raw binary")


CARVED = "key long, seg long, weight long, at int, hash1 long, hash2 long, text binary"


def carve(docs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The texts of runs: one row with the text, or for large keys one row with its hash for each window."""
    lists = texts.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "seg", "weight", "lo", "n", "large")).alias("runs"))  # within a document
    joined = packed(docs).join(lists.hint("shuffle_hash"), ["doc", "tag"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(b.num_rows):
                raw = open_.decompress(b.column(0)[k].as_buffer().to_pybytes())
                key, seg, weight, lo, n, large = (np.asarray(c) for c in b.column(1)[k].values.flatten())
                large = large.astype(bool)
                cold, hot = np.flatnonzero(~large), np.flatnonzero(large)
                if len(cold):
                    none = pa.nulls(len(cold), pa.int64())
                    own = [raw[a:z] for a, z in zip(lo[cold].tolist(), (lo + n + length - 1)[cold].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(key[cold]), pa.array(seg[cold]), pa.array(weight[cold]), pa.nulls(len(cold), pa.int32()), none, none, pa.array(own, pa.binary())], names=[f.split()[0] for f in CARVED.split(", ")])
                for h in hot.tolist():
                    starts = range(int(lo[h]), int(lo[h] + n[h]))
                    pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s : s + length]) for s in starts]), ">i8").astype(np.int64).reshape(-1, 2)
                    same = lambda v: pa.array(np.full(len(pairs), v))
                    yield pa.RecordBatch.from_arrays([same(key[h]), same(seg[h]), same(weight[h]), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.binary())], names=[f.split()[0] for f in CARVED.split(", ")])

    return joined.select("raw", "runs").mapInArrow(rows, CARVED)


def spans_of(flags: np.ndarray) -> np.ndarray:
    """First and one past the last of each run of true flags, one after another."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))


def repeated(texts: list[bytes], weights: list[int], sizes: list[int], length: int) -> np.ndarray:
    """For each byte of all texts together: does a window that occurs more than once in its group start there?

    Groups are ``sizes`` consecutive texts; a text of weight 2 or more stands for as many equal ones.
    """
    raw = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
    own = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(own + 1) - 1
    n = int(ends[-1]) + 1
    symbols = raw[:n].astype(np.int64) + 1
    symbols[ends] = 0
    lengths = np.add.reduceat(own + 1, np.cumsum([0, *sizes[:-1]]))
    order = suffix_orders(symbols, lengths)
    fits = np.repeat(ends, own + 1) - np.arange(n) >= length
    order = order[fits[order]]
    group = np.repeat(np.arange(len(lengths)), lengths)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    equal = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    for at in (*range(0, length - 7, 8), length - 8):  # neighbours whose common prefix is long enough
        equal = equal[words[order[equal] + at] == words[order[equal + 1] + at]]
    found = np.zeros(n, bool)
    found[order[equal]] = found[order[equal + 1]] = True
    several = np.repeat(np.array(weights) > 1, own + 1)
    return found | (several & fits)


def sort_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, seg, weight, text) sorted by key and seg: (key, seg, spans) of windows that occur more than once."""
    held: list[tuple[int, list]] = []
    size = 0

    def work() -> Iterator[pa.RecordBatch]:
        by = sorted((sum(len(t) + 1 for _, _, t in g), k) for k, (_, g) in enumerate(held))
        at = 0
        while at < len(by):
            stop, total = at, 0
            while stop < len(by) and (stop == at or (total + by[stop][0] <= TOGETHER and by[stop][0] <= 2 * by[at][0])):
                total += by[stop][0]
                stop += 1
            groups = [held[k] for _, k in by[at:stop]]
            rows = [(key, *r) for key, g in groups for r in g]
            flags = repeated([r[3] for r in rows], [r[2] for r in rows], [len(g) for _, g in groups], length)
            keys, segs, spans, place = [], [], [], 0
            for key, seg, _, text in rows:
                own = spans_of(flags[place : place + len(text)])
                place += len(text) + 1
                if len(own):
                    keys.append(key)
                    segs.append(seg)
                    spans.append(own)
            if keys:
                offsets = pa.array(np.cumsum([0, *map(len, spans)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(spans).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), lists], names=["key", "seg", "spans"])
            at = stop

    for b in batches:
        for key, seg, weight, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if held and held[-1][0] == key and held[-1][1][-1][0] == seg:
                continue  # a repeated row of the document that stands for this text
            if size > GATHERED and held[-1][0] != key:
                yield from work()
                held, size = [], 0
            if not held or held[-1][0] != key:
                held.append((key, []))
            held[-1][1].append((seg, weight, text))
            size += len(text)
    if held:
        yield from work()


def repeated_windows(docs: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(doc, tag, lo, spans): for each run with repeated windows, which of its windows they are."""
    counted, found = run_rows(docs, length, gram)
    # Facts about keys are written before they meet the runs: a join of two plain exchanges can split a hot key.
    twice = cut(counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "suffix-keys")
    own = cut(found.join(twice, "key", "left_semi"), "suffix-runs")
    distinct = own.groupBy("key", "seg").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "tag", "lo", "n")).alias("r"))
    distinct = cut(distinct.select("key", "seg", "weight", "r.*"), "suffix-distinct")
    facts = distinct.groupBy("key").agg(F.sum(F.col("n") + length - 1).alias("bytes"), F.count("*").alias("segs"))
    facts = cut(facts.select("key", (F.col("segs") == 1).alias("single"), (F.col("bytes") > most).alias("large")), "suffix-facts")
    judged = distinct.join(facts, "key")
    # All texts of the key are one text: in its order every window stands beside its copies.
    alone = F.col("single") & (F.col("weight") > 1)
    whole = judged.filter(alone).select("key", "seg", F.array(F.lit(0), "n").alias("spans"))
    texts = judged.filter(~alone).select("key", "seg", "weight", "doc", "tag", "lo", "n", "large")
    carved = cut(carve(docs, texts, length), "suffix-texts")

    small = carved.filter("text is not null").select("key", "seg", "weight", "text").repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "seg")
    sorted_ = small.mapInArrow(lambda batches: sort_groups(batches, length), "key long, seg long, spans array<int>")

    windows = carved.filter("text is null").select("key", "seg", "weight", "at", "hash1", "hash2").distinct()
    again = windows.groupBy("hash1", "hash2").agg(F.sum("weight").alias("n")).filter("n > 1").select("hash1", "hash2")
    lists = windows.join(again, ["hash1", "hash2"], "left_semi").groupBy("key", "seg").agg(F.sort_array(F.collect_list("at")).alias("at"))  # within a run

    def to_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for x in b.column(2):
                at = np.asarray(x.values)
                flags = np.zeros(int(at[-1]) + 1, bool)
                flags[at] = True
                spans.append(spans_of(flags))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tolist() for s in spans], pa.list_(pa.int32()))], names=["key", "seg", "spans"])

    spans = cut(sorted_.union(lists.mapInArrow(to_spans, "key long, seg long, spans array<int>")).union(whole), "suffix-spans")
    return own.join(spans, ["key", "seg"]).select("doc", "tag", "lo", "spans")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept) for every row of ``docs``.

    Texts are UTF-8 bytes, a null one empty. A byte goes if a string of ``length`` bytes around it also starts
    anywhere else in the texts, the same one included; strings are those of the input and don't cross documents.
    ``removed``: first byte and one past the last of each maximal removed piece, one after another; ``kept``: the other
    bytes together. Repeated rows are repeated texts, so long ones lose everything. ``gram`` is a power of 2, ``length``
    lies between it and ``gram`` + 2,047.
    """
    if not gram <= length < gram + (1 << PLACE) // 2 or gram & (gram - 1) or length < 8:
        raise ValueError("length must lie between gram, a power of 2, and gram + 2047, and be 8 at least")
    found = repeated_windows(docs, length, gram, most)
    # Within a document; a set, so that repeated rows of one id and text don't repeat its runs.
    lists = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "spans")).alias("runs"))
    joined = packed(docs).join(lists.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "raw", "runs")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, removed array<long>, kept binary"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                rows = []
                for raw, found in zip(b.column(1)[k : k + 1000], b.column(2)[k : k + 1000]):
                    raw = open_.decompress(raw.as_buffer().to_pybytes())
                    change = np.zeros(len(raw) + 1, np.int64)
                    if found.is_valid:
                        lo, spans = found.values.flatten()
                        ends = np.asarray(spans.flatten()).astype(np.int64)
                        counts = np.diff(spans.offsets.to_numpy())
                        ends += np.repeat(np.asarray(lo).astype(np.int64), counts)
                        np.add.at(change, ends[::2], 1)
                        np.add.at(change, ends[1::2] - 1 + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    pieces = spans_of(gone)
                    rows.append((len(raw), int(gone.sum()), len(pieces) // 2, pieces, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
                sizes, removed, count, pieces, kept = zip(*rows)
                numbers_ = [pa.array(x, pa.int64()) for x in (sizes, removed, count)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pieces)]).astype(np.int32)), pa.array(np.concatenate(pieces).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1000], *numbers_, lists, pa.array(kept, pa.binary())], names=[f.split()[0] for f in schema.split(", ")])

    out = joined.mapInArrow(apply, schema)
    return out.select(given_id(F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "removed", "kept")
