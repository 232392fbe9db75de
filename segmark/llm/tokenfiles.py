"""Token-id files: patched frame-of-reference blocks with an index of block starts.

Documents are dealt out by id range, encoded, and written as chunks of consecutive documents. The ids of a chunk
are cut into blocks of ``block`` ids. Of each block the smallest id is subtracted; the rest is packed at the width
that holds the given percentile; ids that need more bits leave their low bits in place and put the high bits in an
exception list. A chunk begins with the block starts, so any block can be read alone.

Chunk layout (little-endian): u32 block size, u32 ids, u32 blocks, then for each block u32 start (bytes from the
end of this index), then the blocks: u32 minimum, u8 width, u16 exceptions, packed bits (low bit first), u16
positions, u32 high parts. Files are Parquet tables of chunks, so writing is atomic for each task attempt, any
store that Spark reaches will do, and a reader prunes chunks by document id.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmark.llm.common import given_id, kept_in_worker, known_id, numbers, partitions, split_words, text_rows

BLOCK, PERCENTILE, CHUNK = 1024, 90, 1 << 16
CHUNKS = "part int, chunk int, before long, docs array<long>, lengths array<int>, ids binary"
#: A worker with more words or stems of words than this forgets some before the next texts.
MOST_WORDS, MOST_STEMS = 800_000, 250_000
#: Texts that are encoded together.
TOGETHER = 4000
#: How a byte-level model writes bytes: signs and letters as themselves, the others from U+0100 on.
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SEEN)}
TAIL = re.compile(r"[.,;:!?()\"]+\Z")


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """``ids`` (0 to 2**32 - 1) as one chunk."""
    n, count = len(ids), -(-len(ids) // block)
    head = np.array([block, n, count], "<u4")
    if not n:
        return head.tobytes()
    full = np.pad(ids.astype(np.int64), (0, count * block - n), mode="edge").reshape(count, block)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(block - 1, block * percentile // 100)
    width = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at] + 1)).astype(np.int64)
    parts: list[bytes] = [b""] * count
    for w in np.unique(width):  # 33 values at most
        rows = np.flatnonzero(width == w)
        values = rest[rows]
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, count=int(w), bitorder="little")
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        high = values >> w
        for r, row in enumerate(rows):
            odd = np.flatnonzero(high[r])
            parts[row] = b"".join(
                (low[row].astype("<u4").tobytes(), bytes([w]), np.array(len(odd), "<u2").tobytes(), packed[r].tobytes(), odd.astype("<u2").tobytes(), high[r][odd].astype("<u4").tobytes())
            )
    sizes = np.array([len(p) for p in parts])
    return b"".join((head.tobytes(), (np.cumsum(sizes) - sizes).astype("<u4").tobytes(), *parts))


def unpack_block(data: bytes, k: int) -> np.ndarray:
    """Ids of block ``k`` of a chunk; the last block may be filled up with repeats of the last id."""
    block, _, count = np.frombuffer(data, "<u4", 3)
    at = 12 + 4 * int(count) + int(np.frombuffer(data, "<u4", 1, 12 + 4 * k)[0])
    low, width, odd = int(np.frombuffer(data, "<u4", 1, at)[0]), data[at + 4], int(np.frombuffer(data, "<u2", 1, at + 5)[0])
    at, packed = at + 7, (int(block) * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=int(block) * width, bitorder="little").reshape(int(block), width)
    values = bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) if width else np.zeros(int(block), np.int64)
    where = np.frombuffer(data, "<u2", odd, at + packed)
    values[where] += np.frombuffer(data, "<u4", odd, at + packed + 2 * odd).astype(np.int64) << width
    return values + low


def unpack(data: bytes) -> np.ndarray:
    """All ids of a chunk; blocks of one width are unpacked together."""
    block, n, count = (int(x) for x in np.frombuffer(data, "<u4", 3))
    raw = np.frombuffer(data, np.uint8)
    at = 12 + 4 * count + np.frombuffer(data, "<u4", count, 12).astype(np.int64)
    out = np.zeros((count, block), np.int64)
    widths = raw[at + 4] if count else at
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        if w:
            size = (block * w + 7) // 8
            packed = raw[at[rows, None] + 7 + np.arange(size)]
            bits = np.unpackbits(packed, axis=1, count=block * w, bitorder="little").reshape(len(rows), block, w)
            held = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, 32 - w))), axis=2, bitorder="little")
            out[rows] = held.view("<u4").reshape(len(rows), block)
        for row in rows.tolist():
            k, odd = int(at[row]), int.from_bytes(data[at[row] + 5 : at[row] + 7], "little")
            if odd:
                k += 7 + (block * w + 7) // 8
                out[row, np.frombuffer(data, "<u2", odd, k)] += np.frombuffer(data, "<u4", odd, k + 2 * odd).astype(np.int64) << w
    low = raw[at[:, None] + np.arange(4)].astype(np.int64) @ (1 << np.array([0, 8, 16, 24], np.int64)) if count else np.zeros(0, np.int64)
    return (out + low[:, None]).reshape(-1)[:n]


class Encoder:
    """Encodes the distinct words of many texts with a tokenizer that never looks across white space.

    White space ends a word for this kind of tokenizer (it is dropped before the merges), so a text's ids are the
    ids of its words. Case folds in the tokenizer, so A-Z may fold before words are told apart, but
    for words with "<|": special tokens match by case. Signs after a letter are a word of their own. Known words are Arrow columns, looked up a whole batch at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        self.used, self.turn = np.zeros(0, np.int64), 0
        self.stems: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes words that are new. Latin letters alone are one piece for the tokenizer's model, byte by byte."""
        stems, tokenize, others = self.stems, self.tokenizer.model.tokenize, []
        for w in words:
            plain = ""
            if w.isalpha() and max(w) < "\u0250":
                low = w if w.isascii() else unicodedata.normalize("NFC", w).lower()
                plain = low if w.isascii() else low.encode().decode("latin-1").translate(BYTES) if low.isalpha() else ""
            if plain:
                stems[w] = array("I", [t.id for t in tokenize(plain)]).tobytes()
            else:
                others.append(w)
        for first in range(0, len(others), 2000):
            some = others[first : first + 2000]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                stems[w] = array("I", e.ids).tobytes()

    def add(self, words: list[str]) -> None:
        """Makes ``words``, none of them known, known."""
        parts = []
        for w in words:
            tail = TAIL.search(w)
            at = tail.start() if tail else 0
            apart = at and "<|" not in w and unicodedata.normalize("NFC", w[:at]).lower()[-1].isalpha()
            parts.append((w[:at], w[at:]) if apart else (w,))
        if len(self.stems) > MOST_STEMS:
            self.stems.clear()
        self.learn(list({x for p in parts for x in p} - self.stems.keys()))
        coded = [b"".join([self.stems[x] for x in p]) for p in parts]
        ends = np.cumsum([0, *map(len, coded)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<u4")))
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.ids = pa.concat_arrays([self.ids, lists])
        self.used = np.append(self.used, np.full(len(words), self.turn))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` and the number of ids of each text."""
        words, counts = split_words(texts)
        folded, marked = pc.ascii_lower(words), pc.match_substring(words, "<|")
        if pc.any(marked).as_py():
            folded = pc.if_else(marked, words, folded)
        coded = folded.dictionary_encode()
        self.turn += 1
        if len(self.words) > MOST_WORDS:  # those that were asked for last stay
            keep = np.sort(np.argsort(self.used, kind="stable")[-(MOST_WORDS // 2) :])
            self.words, self.ids, self.used = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.used[keep]
        at = pc.index_in(coded.dictionary, value_set=self.words)
        self.used[numbers(at.drop_null())] = self.turn
        if at.null_count:
            self.add(coded.dictionary.filter(pc.is_null(at)).to_pylist())
            at = pc.index_in(coded.dictionary, value_set=self.words)
        taken = self.ids.take(at.take(coded.indices))
        ends = taken.offsets.to_numpy()[np.append(0, np.cumsum(counts))]
        return taken.flatten().to_numpy(), np.diff(ends).astype(np.int64)


def encoder(path: str) -> Encoder:
    return kept_in_worker(("encoder", path), lambda: Encoder(path))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of ``TOGETHER`` rows at a time, or fewer that have so many bytes as is usual for so many."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= TOGETHER or sum(x.nbytes for x in held) >= TOGETHER * 4096:
            yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in held))]
            held = []
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in held))]


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, block: int = BLOCK, percentile: int = PERCENTILE, chunk: int = CHUNK) -> None:
    """Writes the ids of all texts, ``end_id`` after each, in ascending order of ids, null last, and of texts.

    Rows of one id come in the order of their texts' hash and then of the texts, so that they may part between tasks
    and a rerun writes the same. A chunk holds whole documents and is closed when it has ``chunk`` ids. No rows: no chunks.
    """
    rows = text_rows(docs, known_id().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    order = "doc", F.xxhash64("text"), "text"
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3

        def chunks(doc, lengths, ids, last):
            nonlocal number, before, held
            at = first = 0
            ends = np.cumsum(lengths)
            while first < len(doc):
                k = int(np.searchsorted(ends, at + chunk)) + 1
                if k > len(doc) and not last:
                    break
                k = min(k, len(doc))
                stop = int(ends[k - 1])
                values = (part, number, before, doc[first:k].tolist(), lengths[first:k].tolist(), pack(ids[at:stop], block, percentile))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["part", "chunk", "before", "docs", "lengths", "ids"])
                number, before, first, at = number + 1, before + stop - at, k, stop
            held = doc[first:], lengths[first:], ids[at:]

        for docs, texts in gathered(batches):
            ids, lengths = encoder(path).encode(texts)
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            yield from chunks(*(np.concatenate(x) for x in zip(held, (numbers(docs), lengths + 1, ids))), False)
            pa.default_memory_pool().release_unused()
        yield from chunks(*held, True)

    ranged.mapInArrow(encode, CHUNKS).write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) for each document of ``folder``, decoded from its chunks.

    The checksum is that of the decoded ids as little-endian unsigned 32-bit numbers; ``with_ids`` = False leaves
    the ids themselves out of the result.
    """
    files = spark.read.schema(CHUNKS).parquet(folder)
    sizes = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:  # one for each writing task
        starts.append((r.part, total))
        total += r.n
    names = ["doc", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                base, before = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                lengths = np.asarray(b.column(3)[k].values).astype(np.int64)
                ids, ends = unpack(b.column(4)[k].as_buffer().to_pybytes()), np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - lengths).tolist(), ends.tolist())]
                columns = [b.column(2)[k].values, pa.array(base + before + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    bases = spark.createDataFrame(starts, "part int, base long")
    rows = text_rows(files.join(F.broadcast(bases), "part"), "base", "before", "docs", "lengths", "ids")
    out = rows.mapInArrow(decode, "doc long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.select(given_id(F.col("doc")).alias("doc_id"), *names[1:])
