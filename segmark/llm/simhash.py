"""SimHash near-dedup by bit-sliced comparison.

Equal fingerprints are put together first. The 64 bits are cut into ``bands`` and every fingerprint goes to a bucket
for each choice of ``bands - radius`` bands: two fingerprints within the radius agree on all bits of one choice at
least. In a bucket the fingerprints are stored as bit planes, one bit of 64 fingerprints in one word. Distances of
whole words of fingerprints grow plane by plane in carry-save counters, and a tile is left as soon as all of its
distances are beyond the radius. A tile gives on only links between groups not yet joined. Buckets of more than
``most`` fingerprints are cut into chunks that meet in pairs, each pair in a task of its own.

Copies by shingle similarity (``deduplicate_similar``) differ in more bits than choices of bands can cover. There the
buckets come from bands of minimal shingle hashes, the fingerprints are compared as above at a wide radius, and what
they join is verified text by text by the exact Jaccard similarity of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import components, free_name, given_id, known_id, numbers, partitions, ranges, text_rows
from segmark.llm.mixing import numbered
from segmark.session import cut

SEED = 42
#: Buckets up to this size are compared pair by pair, together with all others of a batch.
SMALL = 12
#: Of the search by similarity: bands of minimal hashes, hashes of a band, and texts of a chunk that are verified together.
MIN_BANDS, MIN_ROWS, MOST_TEXTS = 24, 6, 1024
_RNG = np.random.default_rng(SEED)
SALTS = _RNG.integers(0, 1 << 32, (MIN_BANDS * MIN_ROWS, 1), np.uint32)
FACTORS = _RNG.integers(0, 1 << 32, (MIN_BANDS * MIN_ROWS, 1), np.uint32) | np.uint32(1)


def shingles(text: bytes | None, width: int) -> list[int]:
    """The hashes of all ``width``-word shingles, with repeats; fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-width] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64 majority bits of the hashes of all ``width``-word shingles, as a signed number; no word: 0."""
    return majority(shingles(text, width))


def majority(hashes: list[int] | np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc, tag, fp) for every row of ``docs``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int64())], names=["doc", "tag", "fp"])

    return text_rows(docs, known_id().alias("doc"), F.xxhash64("text").alias("tag"), "text").mapInArrow(rows, "doc long, tag long, fp long")


def masks(bands: int, radius: int) -> list[int]:
    """For each choice of ``bands - radius`` bands, their bits as a signed number."""
    edges = [64 * k // bands for k in range(bands + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [(x - (1 << 64) if x >> 63 else x) for x in (sum(c) for c in combinations(single, bands - radius))]


def within(planes: Iterator[np.ndarray], radius: int, beyond: np.ndarray) -> np.ndarray | None:
    """Bits of the distances that are ``radius`` or less. ``planes``: difference bits; ``beyond``: bits out from the start.

    Returns None when all are beyond the radius before the planes are through.
    """
    size = radius.bit_length()
    counters = [np.zeros_like(beyond) for _ in range(size)]
    full = ~np.uint64(0)

    def over() -> np.ndarray:
        greater, equal = beyond.copy(), np.full_like(beyond, full)
        for k in reversed(range(size)):
            if not radius >> k & 1:
                greater |= equal & counters[k]
                equal &= ~counters[k]
            else:
                equal &= counters[k]
        return greater

    for n, carry in enumerate(planes, 1):
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond = beyond | carry
        if n % 8 == 0 and n < 64 and (over() == full).all():
            return None
    return ~over()


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit p of fingerprint i is bit i % 64 of word i // 64 in plane p; missing fingerprints are 0."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -len(fps) % 64), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(*words.shape[:-1], -1), axis=-1, bitorder="little")[..., :n].astype(bool)


def tile_links(queries: np.ndarray, fps: np.ndarray, radius: int, tile: int = 64) -> list[tuple[int, int]]:
    """Links that join what ``queries`` and ``fps`` have within the radius, one fewer than joined fingerprints at most."""
    planes, n, links = planes_of(fps), len(fps), []
    nodes = np.concatenate([fps, queries])
    group = np.arange(len(nodes))
    out = np.zeros(planes.shape[1], np.uint64)
    out[-1] = ~np.uint64(0) << np.uint64(n % 64) if n % 64 else np.uint64(0)
    for first in range(0, len(queries), tile):
        some = queries[first : first + tile]
        flip = np.where((some[:, None] >> np.arange(64)) & 1, ~np.uint64(0), np.uint64(0))
        near = within((planes[p][None, :] ^ flip[:, p, None] for p in range(64)), radius, np.broadcast_to(out, (len(some), len(out))))
        if near is None:
            continue
        q, i = np.nonzero(unpacked(np.ascontiguousarray(near), n))
        a, b = group[n + first + q], group[i]
        new = a != b
        if not new.any():
            continue
        pairs = np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])], 1), axis=0)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(nodes[x]), int(nodes[y])))
        moved = np.arange(len(nodes))
        for x in root:
            moved[x] = top(x)
        group = moved[group]
    return [(a, b) for a, b in links if a != b]


def pair_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """(n, 2): all links in many small buckets, whose pairs share the words of the planes."""
    found = []
    for step in range(1, int(sizes.max(initial=1))):
        rows = starts[sizes > step]
        a = ranges(rows, sizes[sizes > step] - step)
        for k in range(0, len(a), 1 << 16):
            left, right = fps[a[k : k + (1 << 16)]], fps[a[k : k + (1 << 16)] + step]
            planes = planes_of(left ^ right)
            near = within(iter(planes), radius, np.zeros(planes.shape[1], np.uint64))
            if near is not None:
                hit = unpacked(near, len(left))
                found.append(np.stack([left[hit], right[hit]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def links(fps: DataFrame, radius: int, bands: int, most: int) -> DataFrame:
    """(a, b) of fingerprints within the radius: enough of them to join whatever chains of such pairs join."""
    choices = F.array(*(F.lit(m) for m in masks(bands, radius)))
    rows = fps.select("fp", F.posexplode(choices).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    return bucket_links(rows, radius, most)


def bucket_links(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b) as ``links`` gives them, of fingerprints that share a bucket: rows (fp, choice, key)."""
    large = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    large = cut(large.select("choice", "key", F.ceil(F.col("n") / most).cast("int").alias("chunks")), "simhash-large")
    plain = rows.join(large, ["choice", "key"], "left_anti").select("choice", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("chunk"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("x"), F.greatest(c, F.col("chunk")).alias("y")))
    split = rows.join(large, ["choice", "key"]).withColumn("chunk", own).withColumn("cell", F.explode(cells)).select("choice", "key", "cell.x", "cell.y", "chunk", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: np.ndarray, chunk: np.ndarray, fp: np.ndarray) -> Iterator[np.ndarray]:
            new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            few = sizes <= SMALL
            whole = keys[starts, 2] == keys[starts, 3]
            yield pair_links(fp, starts[few & whole & (sizes > 1)], sizes[few & whole & (sizes > 1)], radius)
            for s, n, one in zip(starts[~few | ~whole], sizes[~few | ~whole], whole[~few | ~whole]):
                own = fp[s : s + n]
                if one:
                    yield np.array(tile_links(own, own, radius), np.int64).reshape(-1, 2)
                    continue
                low = chunk[s : s + n] == keys[s, 2]
                if low.any() and not low.all():
                    yield np.array(tile_links(own[low], own[~low], radius), np.int64).reshape(-1, 2)

        def give(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])

        held = None
        for b in batches:
            new = [np.stack([numbers(b.column(i)) for i in range(4)], 1), numbers(b.column(4)), numbers(b.column(5))]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            keys = held[0]
            differ = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(differ):  # the last bucket may go on in the next batch
                at = int(differ[-1]) + 1
                yield from give(done(*(x[:at] for x in held)))
                held = [x[at:] for x in held]
        if held and len(held[2]):
            yield from give(done(*held))

    n, by = partitions(rows.sparkSession), ["choice", "key", "x", "y"]
    dealt = plain.union(split).repartition(n, *by).sortWithinPartitions(*by, "fp")
    return dealt.mapInArrow(compare, "a long, b long")


def group(docs: DataFrame, width: int = 4, radius: int = 4, bands: int = 6, most: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints are taken from whole texts: A-Z in lower case, words between ASCII white space, all shingles of
    ``width`` words with repeats (fewer words: all of them; none or null: fingerprint 0). Rows whose fingerprints
    differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest id that links reach. Null ids come
    last and may stand in for a component only if all of its ids are null. More ``bands`` mean smaller buckets and
    more of them: six suit up to some hundred million distinct texts, seven or eight more.
    """
    found = members(docs, width, radius, bands, most)
    return found.select(given_id(F.col("doc")).alias("doc_id"), "fp", given_id(F.col("least")).alias("component_id"))


def members(docs: DataFrame, width: int, radius: int, bands: int, most: int) -> DataFrame:
    """(doc, tag, fp, least) for every row: ids without nulls, the text's hash, fingerprint, smallest id reached."""
    own = cut(fingerprints(docs, width), "simhash-docs")
    first = cut(own.groupBy("fp").agg(F.min("doc").alias("doc")), "simhash-distinct")
    joined = components(cut(links(first.select("fp"), radius, bands, most), "simhash-links"), "simhash-stars")
    named = first.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("doc").alias("least"))
    ids = named.join(least, "root").select("fp", "least")
    return own.join(ids, "fp").select("doc", "tag", "fp", "least")


def distinct_shingles(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingles(text, width), np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """For each band, its hash of the minimal hashes of a set of shingles; sets of similarity s share each with s ** MIN_ROWS."""
    short = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(MIN_BANDS * MIN_ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(short), 1024):
        np.minimum(least, ((short[k : k + 1024] ^ SALTS) * FACTORS).min(axis=1), out=least)
    raw, step = least.tobytes(), 4 * MIN_ROWS
    return [xxhash.xxh64_intdigest(raw[k : k + step], SEED) for k in range(0, len(raw), step)]


def sketches(docs: DataFrame, uid: str, width: int) -> DataFrame:
    """(uid, doc, same, fp, bands) for every row: ``same`` and ``fp`` tell sets of shingles apart, no word has no bands."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [distinct_shingles(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in b.column(2)]
            same = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own], np.uint64).view(np.int64)
            keys = [band_keys(x) if len(x) else [] for x in own]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array([k for x in keys for k in x], np.uint64).view(np.int64)))
            columns = [b.column(0), b.column(1), pa.array(same), pa.array([majority(x) for x in own], pa.int64()), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc", "same", "fp", "bands"])

    columns = F.col(uid).alias("uid"), known_id().alias("doc"), "text"
    return text_rows(docs, *columns).mapInArrow(rows, "uid long, doc long, same long, fp long, bands array<long>")


def similar_links(fps: np.ndarray, sets: list[np.ndarray], low: np.ndarray | None, radius: int, similarity: float, tile: int = 64) -> list[tuple[int, int]]:
    """Places of texts whose sets of shingles are similar, by enough pairs to join all that such pairs join.

    Pairs beyond the radius and those already joined are not verified; with ``low``, only pairs of one in and one
    out of it.
    """
    planes, n, found = planes_of(fps), len(fps), []
    sizes, group = np.array([len(x) for x in sets]), np.arange(n)
    out = np.zeros(planes.shape[1], np.uint64)
    out[-1] = ~np.uint64(0) << np.uint64(n % 64) if n % 64 else np.uint64(0)
    for first in range(0, n, tile):
        some = fps[first : first + tile]
        flip = np.where((some[:, None] >> np.arange(64)) & 1, ~np.uint64(0), np.uint64(0))
        near = within((planes[p][None, :] ^ flip[:, p, None] for p in range(64)), radius, np.broadcast_to(out, (len(some), len(out))))
        if near is None:
            continue
        hits = unpacked(np.ascontiguousarray(near), n)
        for q, hit in enumerate(hits, first):
            at = np.flatnonzero(hit[:q])
            at = at[group[at] != group[q]]
            at = at[np.minimum(sizes[at], sizes[q]) >= similarity * np.maximum(sizes[at], sizes[q])]
            if low is not None:
                at = at[low[at] != low[q]]
            for i in at.tolist():
                if group[i] == group[q]:
                    continue
                both = len(np.intersect1d(sets[i], sets[q], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[q] - both):
                    found.append((q, i))
                    group[group == group[i]] = group[q]
    return found


def similar(docs: DataFrame, uid: str, rows: DataFrame, width: int, radius: int, similarity: float, most: int) -> DataFrame:
    """(a, b): row numbers of ``rows`` (uid, same, fp, bands; one for each set of shingles) whose texts are similar.

    The texts of what the fingerprints join come together once, or as pairs of chunks, and are verified there.
    """
    buckets = rows.select("fp", F.posexplode("bands").alias("choice", "key"))
    joined = components(cut(bucket_links(buckets, radius, most), "similar-links"), "similar-stars")
    named = rows.join(joined, F.col("fp") == F.col("node"), "left").select("uid", "fp", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "similar-named")
    sizes = named.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root", F.ceil(F.col("n") / MOST_TEXTS).cast("int").alias("chunks"))
    asked = named.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
    texts = docs.select(F.col(uid).alias("uid"), "text").join(asked.hint("shuffle_hash"), "uid")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("x"), F.greatest(c, F.col("chunk")).alias("y")))
    dealt = texts.withColumn("cell", F.explode(cells)).select("root", "cell.x", "cell.y", "chunk", "uid", "fp", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            chunk, uids, fps = (np.array(x, np.int64) for x in zip(*(h[:3] for h in held)))
            low = None if key[1] == key[2] else chunk == key[1]
            found = np.array(similar_links(fps, [h[3] for h in held], low, radius, similarity), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(uids[found[:, 0]]), pa.array(uids[found[:, 1]])], names=["a", "b"])

        last, held = None, []
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(6)]
            for root, x, y, chunk, own, fp, text in zip(*columns, b.column(6)):
                if (root, x, y) != last and held:
                    yield from done(last, held)
                    held = []
                last = root, x, y
                held.append((chunk, own, fp, distinct_shingles(text.as_buffer().to_pybytes() if text.is_valid else None, width)))
        if held:
            yield from done(last, held)

    n, by = partitions(docs.sparkSession), ["root", "x", "y"]
    return text_rows(dealt.repartition(n, *by).sortWithinPartitions(*by, "uid")).mapInArrow(verify, "a long, b long")


def deduplicate_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 20, most: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group that texts of like shingles form.

    Two texts are linked if the sets of their ``width``-word shingles (words as in ``group``) have a Jaccard
    similarity of ``similarity`` or more; of each group the row with the smallest id stays, null ids last, and of
    several rows with that id one. Texts without words are one group. Pairs are found by minimal hashes and
    fingerprints within ``radius`` bits: at 0.8 the bands miss 7 of 10,000 pairs by calculation, the radius some more of
    very short texts; none of lower similarity is linked. Measured on the 10,000 raw documents of sf0.1: all 48 pairs of
    different sets at 0.8 or more are found, and the ids kept are those of an exact search.
    """
    rows, uid = numbered(docs, docs.columns)
    own = sketches(rows, uid, width)
    first = own.groupBy("same", "fp").agg(F.min(F.struct("doc", "uid")).alias("least"), F.first("bands").alias("bands"))
    first = cut(first.select("least.doc", "least.uid", "fp", "bands"), "similar-distinct")
    joined = components(cut(similar(rows, uid, first, width, radius, similarity, most), "similar-pairs"), "similar-groups")
    groups = first.join(joined, F.col("uid") == F.col("node"), "left").groupBy(F.coalesce("root", "uid").alias("root"))
    stay = groups.agg(F.min(F.struct("doc", "uid")).alias("least")).select(F.col("least.uid").alias(uid))
    return rows.join(stay.hint("shuffle_hash"), uid, "left_semi").select(*docs.columns)
