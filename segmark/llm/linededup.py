"""Line dedup: lines that several documents share stay in the first of them only.

Hashes of line keys are dealt out by range with documents and positions as further sort keys, so that even one
line in every document spreads over many tasks. Each task streams its sorted rows; what is unknown at a border
between two ranges is one hash for each task. The result is a compressed bitmap of kept lines for each document
that loses any; texts meet it once, at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmark.llm.common import free_name, known_id, numbers, partitions, text_rows
from segmark.session import cut

LINE = "hi long, lo long, doc long, tag long, n_lines int, pos int"
KEY = ["hi", "lo", "doc", "pos", "tag"]


def line_rows(docs: DataFrame, shortest: int) -> DataFrame:
    """A row for each line whose key has ``shortest`` code points or more: 128-bit hash, document, position.

    The key is the line without white space at its ends and with A-Z in lower case. ``tag`` tells different
    texts under one id apart.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = numbers(b.column(0)), numbers(b.column(1))
            digests, owner, place, lines = [], [], [], []
            for i, text in enumerate(b.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                keys = [k.strip() for k in raw.lower().split(b"\n")]
                for pos, key in enumerate(keys):
                    if len(key) >= shortest and len(key.decode("utf-8", "replace")) >= shortest:
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(i)
                        place.append(pos)
                        lines.append(len(keys))
            pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            own = np.array(owner, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(doc[own]), pa.array(tag[own]), pa.array(np.array(lines, np.int32)), pa.array(np.array(place, np.int32))],
                names=["hi", "lo", "doc", "tag", "n_lines", "pos"],
            )

    return text_rows(docs, known_id().alias("doc"), F.xxhash64("text").alias("tag"), "text").mapInArrow(rows, LINE)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document and position: those outside the first document of their hash.

    Rows of the range's first hash are all passed on as ``open`` (the hash may begin in an earlier range), and
    at the end a row without a document tells the last hash's first document.
    """
    names = ["hi", "lo", "doc", "tag", "n_lines", "pos", "first", "open"]
    head = last = None  # hashes; the latter with its first document
    for b in batches:
        if not b.num_rows:
            continue
        hi, lo, doc = (numbers(b.column(i)) for i in range(3))
        head = head or (hi[0], lo[0])
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new[0] = last is None or last[:2] != (hi[0], lo[0])
        start = np.maximum.accumulate(np.where(new, np.arange(len(hi)), -1))
        first = np.where(start >= 0, doc[start], last[2] if last else 0)
        opened = (hi == head[0]) & (lo == head[1])
        last = (hi[-1], lo[-1], first[-1])
        pick = pa.array(opened | (doc != first))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first), pa.array(opened)], names=names).filter(pick)
    if last:
        one = [pa.array([x], k) for x, k in zip((*last[:2], None, None, None, None, last[2], True), (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.int64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(one, names=names)


def dropped_lines(lines: DataFrame) -> DataFrame:
    """The lines that go: those of any document but the first that has their hash."""
    ranged = lines.repartitionByRange(partitions(lines.sparkSession), *KEY).sortWithinPartitions(*KEY)
    found = cut(ranged.mapInArrow(stream, f"{LINE}, first long, open boolean"), "line-runs")
    # Two hashes for each range at most, so this may go to all tasks.
    across = found.filter("open").groupBy("hi", "lo").agg(F.min("first").alias("earliest"))
    opened = found.filter("open and doc is not null").join(F.broadcast(across), ["hi", "lo"]).filter("doc > earliest")
    columns = ["doc", "tag", "n_lines", "pos"]
    return found.filter("not open").select(*columns).union(opened.select(*columns))


def keep_bitmaps(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """(doc, tag, n_dropped, keep) for each document that loses lines; ``keep``: zlib of one bit for each line."""
    gone = dropped_lines(cut(line_rows(docs, shortest), "line-hashes"))
    lists = gone.groupBy("doc", "tag", "n_lines").agg(F.collect_set("pos").alias("gone"))  # a document's own lines

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, counts = [], []
            for n, where in zip(b.column(2).to_pylist(), b.column(3)):
                keep = np.ones(n, bool)
                keep[np.asarray(where.values)] = False
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
                counts.append(int(n - keep.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(bits, pa.binary())], names=["doc", "tag", "n_dropped", "keep"])

    return lists.mapInArrow(pack, "doc long, tag long, n_dropped long, keep binary")


def deduplicate(docs: DataFrame, shortest: int = 10) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` with shared lines removed from ``text``, a struct ``(n_lines, n_dropped)``, and its name.

    A line goes if its key (see ``line_rows``) has at least ``shortest`` code points and stands in a document
    with a smaller id; all of its lines in the smallest stay. Documents are told apart by id; null ids count as
    one document after all others. A null or empty text is one empty line; the other lines are joined by \\n. A
    text that loses nothing is unchanged, null included.
    """
    name = free_name([*docs.columns, "doc", "tag", "keep"], "lines")
    doc, tag, keep = (free_name(docs.columns, x) for x in ("doc", "tag", "keep"))
    maps = keep_bitmaps(docs, shortest).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("keep").alias(keep))
    joined = docs.withColumns({doc: known_id(), tag: F.xxhash64("text")}).join(maps.hint("shuffle_hash"), [doc, tag], "left").select(*docs.columns, keep)
    at = docs.columns.index("text")
    kind = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, gone = [], [], []
            for text, bits in zip(b.column(at), b.column(b.num_columns - 1).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                n = raw.count(b"\n") + 1 if raw else 1
                kept = n
                if bits is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)
                    raw = b"\n".join([x for x, k in zip(raw.split(b"\n"), keep) if k])
                    kept = int(keep.sum())
                texts.append(raw)
                lines.append(n)
                gone.append(n - kept)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            struct = pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["n_lines", "n_dropped"])
            yield pa.RecordBatch.from_arrays([*columns, struct], names=[f.name for f in schema.fields])

    return text_rows(joined).mapInArrow(apply, schema), name
