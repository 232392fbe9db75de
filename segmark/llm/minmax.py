"""Near-dedup by min-max hashing: each permutation gives two signature values, its minimum and its maximum.

A document is the set of its word shingles, hashed to 64 bits from the hashes of their words. Under every permutation
the smallest and the largest value are kept: half as many permutations are worked out as for minima alone, and both
values of two sets agree with the probability of their Jaccard similarity. Bands of minima and bands of maxima put
equal sets, once each, into buckets.

What shares a bucket is confirmed on the full sets. First every set meets the smallest member of each of its buckets
(a star, so rows grow with the members and not with their pairs; a star of many members is salted). Where members of a
bucket are still in different components after that, they meet in cells of bounded size, two chunks of the bucket at a
time, and pairs of different components whose signatures are not far apart are confirmed there too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.llm.common import components, given_id, known_id, numbers, partitions, ranges, split_words, text_rows
from segmark.session import cut

WIDTH, PERCENT = 3, 85
#: Bands and values of a band; half of the bands hold minima, half maxima, so there are BANDS * ROWS / 2 permutations.
BANDS, ROWS = 24, 5
#: Members that a part of a star confirms, and shingles of a chunk of a cell.
STAR, CHUNK = 2048, 1 << 20
#: Standard deviations of the signatures' estimate that a pair in a cell may lie below the similarity.
SLACK = 6.0
_RNG = np.random.default_rng(11)
SALTS = _RNG.integers(0, 1 << 32, BANDS * ROWS // 2, np.uint32)
FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS // 2, np.uint32) | np.uint32(1)
MIXERS = _RNG.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; fewer words are one shingle, no word (or null) none."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)
    each = own[numbers(coded.indices)] if len(words) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = ranges(starts, windows)
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(at), np.uint64)
        reach = np.repeat(np.minimum(counts, width), windows)
        for k in range(width):
            inside = reach > k
            hashes[inside] = mixed(hashes[inside] + each[at[inside] + k] * MIXERS[k]) + MIXERS[width + k]
    bounds = np.append(0, np.cumsum(windows))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * permutations): minima under all permutations, then maxima; the sets must not be empty."""
    out = np.empty((len(sets), 2 * len(SALTS)), np.uint32)
    first = 0
    while first < len(sets):  # as many sets together as stay in the processor's cache
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= 1 << 15):
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        short = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        for p, (salt, factor) in enumerate(zip(SALTS, FACTORS)):
            values = (short ^ salt) * factor
            out[first:last, p] = np.minimum.reduceat(values, starts)
            out[first:last, len(SALTS) + p] = np.maximum.reduceat(values, starts)
        first = last
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, bands): one hash for each band."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(MIXERS[:BANDS], values.shape[:2]).copy()
        for k in range(ROWS):
            key = mixed(key + values[:, :, k] * MIXERS[32 + k])
    return key


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc, tag, one, two, n, bands) for every row: two hashes of the set, its size, its bands' keys (no word: none)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(2), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            keys = band_keys(signatures([s for s in sets if len(s)])).view(np.int64).ravel()
            ends = np.cumsum(np.append(0, np.where(sizes > 0, BANDS, 0))).astype(np.int32)
            columns = [b.column(0), b.column(1), pa.array(np.ascontiguousarray(same[:, 0])), pa.array(np.ascontiguousarray(same[:, 1])), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "one", "two", "n", "bands"])

    columns = known_id().alias("doc"), F.xxhash64("text").alias("tag"), "text"
    return text_rows(docs, *columns).mapInArrow(rows, "doc long, tag long, one long, two long, n long, bands array<long>")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity, on all of their members."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])


def confirm_stars(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): those of ``pairs`` (lead, node) whose sets are alike. ``texts``: (node, text)."""
    n = partitions(texts.sparkSession)
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.join(sizes, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"))
    leads = sizes.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    asked = cut(members.union(leads), "minmax-stars")
    dealt = texts.join(asked.hint("shuffle_hash"), "node").select("lead", "part", "kind", "node", "text")
    dealt = dealt.repartition(n, "lead", "part").sortWithinPartitions("lead", "part", "kind", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            sets, found = shingle_sets(b.column(4), width), []
            lead, kind, node = (numbers(b.column(i)).tolist() for i in (0, 2, 3))
            for own_lead, own_kind, own, members in zip(lead, kind, node, sets):
                if own_kind == 0:
                    held = members  # the lead comes before the members of its part
                elif alike(held, members, percent):
                    found.append((own_lead, own))
            if found:
                yield links_of(found)

    return text_rows(dealt).mapInArrow(confirm, "a long, b long")


def cell_links(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], low: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of alike sets, enough to join what such pairs join; with ``low`` only pairs of one in and one out of it."""
    signature = signatures(sets)
    similarity = percent / 100
    least = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / signature.shape[1])
    sizes, group, found = np.array([len(s) for s in sets]), roots.copy(), []
    for q in range(1, len(sets)):
        open_ = group[:q] != group[q]
        open_ &= 100 * np.minimum(sizes[:q], sizes[q]) >= percent * np.maximum(sizes[:q], sizes[q])
        if low is not None:
            open_ &= low[:q] != low[q]
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        at = at[(signature[at] == signature[q]).mean(axis=1) >= least]
        for i in at.tolist():
            if group[i] != group[q] and alike(sets[i], sets[q], percent):
                found.append((int(nodes[i]), int(nodes[q])))
                group[group == group[i]] = group[q]
    return found


def confirm_cells(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links within buckets between what has different roots. ``members``: (key, node, root, n)."""
    sizes = members.groupBy("key").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("x"), F.greatest(c, F.col("chunk")).alias("y")))
    asked = members.join(sizes, "key").withColumn("chunk", chunk).withColumn("cell", F.explode(cells))
    asked = cut(asked.select("node", "root", "key", "cell.x", "cell.y", "chunk"), "minmax-cells")
    by = ["key", "x", "y"]
    dealt = texts.join(asked.hint("shuffle_hash"), "node").select(*by, "chunk", "node", "root", "text")
    dealt = dealt.repartition(partitions(texts.sparkSession), *by).sortWithinPartitions(*by, "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cell: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            chunk, nodes, roots = (np.array(x, np.int64) for x in zip(*(h[:3] for h in held)))
            found = cell_links(nodes, roots, [h[3] for h in held], None if cell[1] == cell[2] else chunk == cell[1], percent)
            if found:
                yield links_of(found)

        last, held = None, []
        for b in batches:
            sets = shingle_sets(b.column(6), width)
            for *cell, chunk, node, root, own in zip(*(numbers(b.column(i)).tolist() for i in range(6)), sets):
                if tuple(cell) != last:
                    if held:
                        yield from done(last, held)
                    last, held = tuple(cell), []
                if not held or held[-1][1] != node:  # else a repeated row of the document that stands for the set
                    held.append((chunk, node, root, own))
        if held:
            yield from done(last, held)

    return text_rows(dealt).mapInArrow(confirm, "a long, b long")


def group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Whole texts: A-Z in lower case, words between ASCII white space, the set of shingles of ``width`` words; fewer
    words are one shingle. A text without a word, or null, has no shingle and is linked with nothing. Two documents
    are linked if 100 * |A and B| >= ``percent`` * |A or B|; equal sets always are. ``component_id`` is the smallest
    id that links reach; null ids come last and stand in for a component only if all of its ids are null. ``kept``:
    the row has its component's id (or lacks one like all others of it), so repeated rows of that id stay together.
    Two sets at exactly 0.85 miss all bands with a probability of 8e-7 (24 bands of 5 values).
    """
    own = cut(sketches(docs, width), "minmax-docs")
    distinct = own.filter("n > 0").groupBy("one", "two").agg(F.min(F.struct("doc", "tag")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # Written once, so that the row numbers stay.
    distinct = cut(distinct.select("one", "two", "r.doc", "r.tag", "n", "bands").withColumn("node", F.monotonically_increasing_id()), "minmax-sets")

    entries = distinct.select("node", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("m")).filter("m > 1")
    buckets = cut(entries.join(shared, "key").filter("node <> lead"), "minmax-buckets")
    plain = docs.select(known_id().alias("doc"), F.xxhash64("text").alias("tag"), "text")
    asked = distinct.join(buckets.select("node").union(buckets.select("lead")).distinct(), "node").select("doc", "tag", "node")
    texts = plain.join(asked.hint("shuffle_hash"), ["doc", "tag"]).select("node", "text")
    stars = cut(confirm_stars(texts, buckets.select("lead", "node").distinct(), width, percent), "minmax-star-links")
    joined = components(stars, "minmax-star-roots")

    # Buckets whose members besides the lead are still apart, each list of members once.
    rooted = buckets.filter("m > 2").join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    rooted = cut(rooted.select("key", "node", "n", F.coalesce("root", "node").alias("root")), "minmax-rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("list"), F.min("node").alias("least"))
    apart = apart.filter("low <> high").groupBy("m", "list", "least").agg(F.min("key").alias("key")).select("key")
    members = cut(rooted.join(apart, "key"), "minmax-apart")
    cells = cut(confirm_cells(texts, members, width, percent), "minmax-cell-links")

    joined = components(stars.union(cells), "minmax-roots")
    named = distinct.select("one", "two", "doc", "node").join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = cut(named.select("one", "two", "doc", F.coalesce("root", "node").alias("root")), "minmax-named")
    ids = named.join(named.groupBy("root").agg(F.min("doc").alias("least")), "root").select("one", "two", "least")
    ids = cut(ids, "minmax-ids")
    least = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    out = own.select("doc", "n", "one", "two").join(ids, ["one", "two"], "left").select("doc", "n", least.alias("least"))
    return out.select(given_id(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), given_id(F.col("least")).alias("component_id"), (F.col("doc") == F.col("least")).alias("kept"))
