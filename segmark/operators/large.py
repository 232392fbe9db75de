"""Recordings too long for one task: split off by a length check, then aligned tile by tile.

The edit table of a long recording is cut into square tiles. A tile needs only the last row of the tile
above and the last column of the tile to its left, so all tiles on one anti-diagonal run in parallel and
each step hands on edges, written to the shared folder. The path is then walked back tile by tile for all
long recordings at once. Boundaries are matched in blocks of time. Results equal those of the one-task
path; no task holds more than one tile or one block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmark.functions import text
from segmark.functions.editpath import sweep, walk
from segmark.functions.matching import match_one
from segmark.operators.blockscan import fold_blocks
from segmark.operators.boundaries import tolerance_tags
from segmark.operators.scan import with_rank
from segmark.operators.seqalign import boundary_errors
from segmark.session import cut, cut_path

#: Labels per side of a tile.
TILE = 1 << 13
#: Above every cost.
FAR = 1 << 40
#: Seconds of boundaries one task matches.
BLOCK_SECONDS = 3600.0
#: Most long recordings whose names are broadcast.
MAX_HOT = 200_000


def split_by_length(
    store: DataFrame, limit: int, longest: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(intervals of recordings up to ``limit`` labels per side, the others or None)."""
    sizes = store.groupBy("utt", "side").agg(F.count("*").alias("n"))
    if longest is None:
        longest = sizes.agg(F.max("n")).first()[0] or 0
    if longest <= limit:
        return store, None
    long_ones = cut(sizes.filter(F.col("n") > limit).select("utt").distinct(), "long")
    if long_ones.count() <= MAX_HOT:
        # Few by nature; broadcast, so the rows of a long recording need not meet in one task.
        long_ones = F.broadcast(long_ones)
    return store.join(long_ones, "utt", "left_anti"), store.join(long_ones, "utt", "left_semi")


def join_facts(
    rows: DataFrame, facts: DataFrame, is_long: Column, longest: int, limit: int, on: Sequence[str] = ("utt",)
) -> DataFrame:
    """Inner join of rows with one row of facts per recording (or chunk: the columns ``on``).

    Long ones are joined by broadcast, the others by shuffle: no key of the shuffle is hot.
    """
    on = list(on)
    if longest <= limit:
        return rows.join(facts, on)
    hot = facts.filter(is_long)
    if hot.count() > MAX_HOT:
        return rows.join(facts, on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(others.join(facts.filter(~is_long), on))


def _codes(ref, hyp) -> tuple[np.ndarray, np.ndarray]:
    codes, _ = pd.factorize(np.concatenate([np.asarray(ref, object), np.asarray(hyp, object)]))
    return codes[: len(ref)], codes[len(ref) :]


def _edges(row, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Top row and left column of a tile; the table's own border counts up from 0, a side outside the band is far."""
    i, j = row.bi * tile, row.bj * tile
    if row.bi == 0:
        top = np.arange(j, j + len(row.hyp) + 1)
    else:
        top = np.full(len(row.hyp) + 1, FAR) if row.top is None else np.array(row.top, np.int64)
    if row.bj == 0:
        left = np.arange(i, i + len(row.ref) + 1)
    else:
        left = np.full(len(row.ref) + 1, FAR) if row.left is None else np.array(row.left, np.int64)
    top[0] = left[0] = min(top[0], left[0])
    return top, left


def _tiles(labels: DataFrame, side: str, index: str, tile: int) -> DataFrame:
    own = labels.filter(F.col("side") == side)
    listed = F.sort_array(F.collect_list(F.struct("pos", "phoneme")))
    return own.groupBy("utt", F.floor(F.col("pos") / tile).cast("long").alias(index)).agg(
        listed["phoneme"].alias(side)
    )


def _band(sizes: DataFrame, budget: Column, tile: int) -> DataFrame:
    """(utt, rows, columns, low, high, budget): tiles of a recording and the diagonals bj - bi that its band meets.

    A path of cost ``budget`` or less passes no cell (i, j) with |j - i| + |m - n - (j - i)| above it.
    """
    gap = F.col("m") - F.col("n")
    slack = F.floor((F.col("budget") - F.abs(gap)) / 2)
    low, high = F.least(gap, F.lit(0)) - slack, F.greatest(gap, F.lit(0)) + slack
    return sizes.withColumn("budget", budget).select(
        "utt",
        F.ceil(F.col("n") / tile).alias("rows"),
        F.ceil(F.col("m") / tile).alias("columns"),
        (F.ceil(low / tile) - 1).alias("low"),
        (F.floor(high / tile) + 1).alias("high"),
        "budget",
    )


def _joined_tiles(at: DataFrame, refs: DataFrame, hyps: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Tiles ``at`` (utt, bi, bj, ...) with their labels and, from the wave before, their top and left sides."""
    work = at.join(refs, ["utt", "bi"]).join(hyps, ["utt", "bj"])
    if edges is None:
        none = F.lit(None).cast("array<long>")
        return work.select("*", none.alias("top"), none.alias("left"))
    down = edges.select("utt", (F.col("bi") + 1).alias("bi"), "bj", F.col("bottom").alias("top"))
    over = edges.select("utt", "bi", (F.col("bj") + 1).alias("bj"), F.col("right").alias("left"))
    return work.join(down, ["utt", "bi", "bj"], "left").join(over, ["utt", "bi", "bj"], "left")


EDGES = "utt string, bi long, bj long, cost long, bottom array<long>, right array<long>"
STEPS = "utt string, i long, j long, pairs array<struct<ref_idx:long,hyp_idx:long>>"


def _fill(grid: DataFrame, refs: DataFrame, hyps: DataFrame, folder: str, waves: int, tile: int) -> None:
    """Fills the tiles of each recording's band, wave by wave; a wave's bottom and right sides are one table."""
    spark = grid.sparkSession

    def fill(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                bottom, right, _ = sweep(*_codes(row.ref, row.hyp), *_edges(row, tile))
                out.append((row.utt, row.bi, row.bj, bottom[-1], bottom, right))
            yield pd.DataFrame(out, columns=["utt", "bi", "bj", "cost", "bottom", "right"])

    edges = None
    for w in range(waves):
        wave = F.lit(w)
        first = F.greatest(F.lit(0), wave - F.col("columns") + 1, F.ceil((wave - F.col("high")) / 2))
        last = F.least(wave, F.col("rows") - 1, F.floor((wave - F.col("low")) / 2))
        active = grid.filter(first <= last).select("utt", F.explode(F.sequence(first, last).cast("array<long>")).alias("bi"))
        work = _joined_tiles(active.withColumn("bj", wave - F.col("bi")), refs, hyps, edges)
        work.repartition("utt", "bi").mapInPandas(fill, EDGES).write.parquet(f"{folder}/w={w}")
        edges = spark.read.schema(EDGES).parquet(f"{folder}/w={w}")


def _walk_back(ends: DataFrame, refs: DataFrame, hyps: DataFrame, folder: str, waves: int, tile: int) -> DataFrame:
    """(utt, ref_idx, hyp_idx) along the paths from ``ends`` (utt, i, j), read from the waves' sides.

    A path goes from a tile to one of an earlier wave, so each wave's table is read once at most.
    """
    spark = ends.sparkSession

    def back(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                i0, j0 = row.bi * tile, row.bj * tile
                steps, i, j = walk(*_codes(row.ref, row.hyp), *_edges(row, tile), row.i - i0, row.j - j0)
                pairs = [{"ref_idx": i0 + a, "hyp_idx": j0 + b} for a, b in steps if a >= 0 and b >= 0]
                out.append((row.utt, i0 + i, j0 + j, pairs))
            yield pd.DataFrame(out, columns=["utt", "i", "j", "pairs"])

    at = ends
    inside = (F.col("i") > 0) & (F.col("j") > 0)
    for w in reversed(range(waves)):
        bi, bj = (F.floor((F.col(c) - 1) / tile).cast("long") for c in ("i", "j"))
        placed = at.filter(inside).withColumns({"bi": bi, "bj": bj})
        here = F.col("bi") + F.col("bj") == w
        edges = spark.read.schema(EDGES).parquet(f"{folder}/w={w - 1}") if w else None
        moved = _joined_tiles(placed.filter(here), refs, hyps, edges).mapInPandas(back, STEPS)
        waiting = placed.filter(~here).select("utt", "i", "j", F.lit(None).cast("array<struct<ref_idx:long,hyp_idx:long>>").alias("pairs"))
        moved.union(waiting).write.parquet(f"{folder}/path-{w}")
        at = spark.read.schema(STEPS).parquet(f"{folder}/path-{w}").select("utt", "i", "j")
    paths = [f"{folder}/path-{w}" for w in range(waves)]
    return spark.read.schema(STEPS).parquet(*paths).filter("pairs is not null").select("utt", F.inline("pairs"))


def tiled_pairs(labels: DataFrame, tile: int = TILE) -> DataFrame:
    """Paired positions (utt, ref_idx, hyp_idx) of long label sequences (utt, side, pos, phoneme).

    Labels without a pair are deletions or insertions. Both sides of every recording must be present. Only tiles in a
    band around the diagonal are filled. The band holds every path of a cost up to its budget, so once the corner costs
    no more, all best paths lie inside and the one walked back is that of the whole table; otherwise the budget is
    doubled, until the band is the table.
    """
    spark = labels.sparkSession
    refs = cut(_tiles(labels, "ref", "bi", tile), "tiles")
    hyps = cut(_tiles(labels, "hyp", "bj", tile), "tiles")
    sizes = cut(
        labels.groupBy("utt").agg(
            F.count_if(F.col("side") == "ref").alias("n"), F.count_if(F.col("side") == "hyp").alias("m")
        ),
        "sizes",
    )
    open_ = sizes.withColumn("extra", F.lit(tile).cast("long"))
    found = None
    while True:
        grid = cut(_band(open_, F.abs(F.col("m") - F.col("n")) + F.col("extra"), tile), "band")
        waves = grid.agg(F.max(F.col("rows") + F.col("columns") - 1)).first()[0] or 0
        folder = cut_path(spark, "waves")
        _fill(grid, refs, hyps, folder, waves, tile)
        if waves:
            corners = spark.read.schema(EDGES).parquet(*(f"{folder}/w={w}" for w in range(waves))).select("utt", "bi", "bj", "cost")
            last = (F.col("bi") == F.col("rows") - 1) & (F.col("bj") == F.col("columns") - 1)
            costs = corners.join(grid, "utt").filter(last & (F.col("cost") <= F.col("budget"))).select("utt")
            settled = cut(sizes.join(costs, "utt"), "settled")
        else:
            settled = sizes.limit(0)
        ends = settled.select("utt", F.col("n").alias("i"), F.col("m").alias("j"))
        pairs = _walk_back(ends, refs, hyps, folder, waves, tile) if waves else labels.select("utt", F.lit(0).cast("long").alias("ref_idx"), F.lit(0).cast("long").alias("hyp_idx")).limit(0)
        found = pairs if found is None else found.union(pairs)
        open_ = cut(open_.join(settled.select("utt"), "utt", "left_anti").withColumn("extra", F.col("extra") * 2), "open")
        if open_.isEmpty():
            return found


def blocked_hits(bounds: DataFrame, tolerance: float, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Matched boundaries per recording (utt, tp) from distinct boundaries (utt, side, t).

    A block owns the reference boundaries of its time span and sees the hypothesis boundaries around it;
    its state is which of those near its end are taken.
    """
    length = max(float(block_seconds), 16 * tolerance)
    reach = 2 * tolerance
    own = F.floor(F.col("t") / length).cast("long")
    near = F.array_compact(
        F.array(
            own,
            F.when(F.col("t") - own * F.lit(length) <= reach, own - 1),
            F.when((own + 1) * F.lit(length) - F.col("t") <= reach, own + 1),
        )
    )
    blocks_of = F.when(F.col("side") == "ref", F.array(own)).otherwise(near)

    def listed(side: str):
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("t")))).alias(side)

    blocks = (
        bounds.select("utt", "side", "t", F.explode(blocks_of).alias("blk"))
        .groupBy("utt", "blk")
        .agg(listed("ref"), listed("hyp"))
        .filter(F.size("ref") > 0)
    )

    def match(batches):
        for pdf in batches:
            hits, states = [], []
            for row in pdf.itertuples(index=False):
                hyp = np.asarray(row.hyp, float)
                used = np.isin(hyp, row.state_in) if row.state_in is not None else np.zeros(len(hyp), bool)
                taken = match_one(np.asarray(row.ref, float), hyp, tolerance, used)
                left = hyp[used & (hyp >= (row.blk + 1) * length - reach)]
                hits.append(int((taken >= 0).sum()))
                states.append(left if len(left) else None)
            pdf["out"], pdf["state_out"] = hits, states
            yield pdf

    schema = "utt string, blk long, ref array<double>, hyp array<double>, state_in array<double>, out long, state_out array<double>"
    folded = fold_blocks(blocks, ["utt"], lambda d: d.mapInPandas(match, schema), "array<double>")
    return folded.groupBy("utt").agg(F.sum("out").alias("tp"))


def boundary_rows(rows: DataFrame) -> DataFrame:
    """Distinct boundaries (utt, side, t): every onset and the last offset."""
    last = rows.groupBy("utt", "side").agg(F.max_by("end_s", "pos").alias("t"))
    return rows.select("utt", "side", F.col("start_s").alias("t")).unionByName(last).distinct()


def _as_words(rows: DataFrame) -> DataFrame:
    """Labels split at blanks and numbered anew, as the edit counts want them."""
    words = rows.select("utt", "side", "pos", F.posexplode(text.words(F.col("phoneme"))).alias("k", "phoneme"))
    ranked = with_rank(words.withColumnRenamed("pos", "p"), ["utt", "side"], ["p", "k"], 1 << 62)
    return cut(ranked.select("utt", "side", "pos", "phoneme"), "words")


def _edit_counts(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(utt, s, d, i) from paired positions."""
    sizes = labels.groupBy("utt").agg(
        F.count_if(F.col("side") == "ref").alias("n"), F.count_if(F.col("side") == "hyp").alias("m")
    )
    side = {s: labels.filter(F.col("side") == s) for s in ("ref", "hyp")}
    joined = pairs.join(
        side["ref"].select("utt", F.col("pos").alias("ref_idx"), F.col("phoneme").alias("rp")), ["utt", "ref_idx"]
    ).join(side["hyp"].select("utt", F.col("pos").alias("hyp_idx"), F.col("phoneme").alias("hp")), ["utt", "hyp_idx"])
    paired = joined.groupBy("utt").agg(
        F.count("*").alias("p"), F.count_if(F.col("rp") != F.col("hp")).alias("s")
    )
    p = F.coalesce("p", F.lit(0))
    return sizes.join(paired, "utt", "left").select(
        "utt",
        F.coalesce("s", F.lit(0)).cast("int").alias("s"),
        (F.col("n") - p).cast("int").alias("d"),
        (F.col("m") - p).cast("int").alias("i"),
    )


def long_rows(big: DataFrame, order: str) -> DataFrame:
    """Rows of long recordings with their dense position, written once."""
    # Length is unbounded here, so positions always come from the range-partitioned rank.
    ranked = with_rank(big.withColumnRenamed(order, "__ord"), ["utt", "side"], ["__ord"], 1 << 62)
    return cut(ranked.select("utt", "file", "style", "side", "pos", "phoneme", "start_s", "end_s"), "large")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    item = "struct(phoneme, start_s, end_s)"
    return (
        rows.filter("side = 'ref'").selectExpr("utt", "style", "pos AS ref_idx", f"{item} AS r"),
        rows.filter("side = 'hyp'").selectExpr("utt", "pos AS hyp_idx", f"{item} AS h"),
    )


def large_matches(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with equal labels and both intervals (utt, style, ref_idx, hyp_idx, r, h)."""
    ref, hyp = _sides(rows)
    return (
        pairs.join(ref, ["utt", "ref_idx"])
        .join(hyp, ["utt", "hyp_idx"])
        .filter("r.phoneme = h.phoneme")
        .selectExpr("utt", "style", "CAST(ref_idx AS INT) AS ref_idx", "CAST(hyp_idx AS INT) AS hyp_idx", "r", "h")
    )


def large_pair_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every step of the edit path with its kind and both labels, as ``seqalign.pair_rows`` gives it."""
    ref, hyp = _sides(rows)
    both = pairs.join(ref, ["utt", "ref_idx"]).join(hyp, ["utt", "hyp_idx"])
    op = "IF(r.phoneme = h.phoneme, 'match', 'sub')"
    tail = ["r.phoneme AS ref_phoneme", "h.phoneme AS hyp_phoneme"]
    index = ["CAST(ref_idx AS INT) AS ref_idx", "CAST(hyp_idx AS INT) AS hyp_idx"]
    none = "CAST(NULL AS STRING)"
    dropped = ref.join(pairs, ["utt", "ref_idx"], "left_anti").selectExpr(
        "utt", index[0], "CAST(NULL AS INT) AS hyp_idx", tail[0], f"{none} AS hyp_phoneme", "'del' AS op"
    )
    added = hyp.join(pairs, ["utt", "hyp_idx"], "left_anti").selectExpr(
        "utt", "CAST(NULL AS INT) AS ref_idx", index[1], f"{none} AS ref_phoneme", tail[1], "'ins' AS op"
    )
    return both.selectExpr("utt", *index, *tail, f"{op} AS op").unionByName(dropped).unionByName(added)


def large_edit_counts(rows: DataFrame, tile: int = TILE, pairs: DataFrame | None = None) -> DataFrame:
    """(utt, s, d, i) of long recordings; labels holding blanks count as several words."""
    labels = rows.select("utt", "side", "pos", "phoneme")
    if rows.filter(text.may_split(F.col("phoneme"))).isEmpty():
        return _edit_counts(labels, tiled_pairs(labels, tile) if pairs is None else pairs)
    words = _as_words(rows)
    return _edit_counts(words, tiled_pairs(words, tile))


def large_boundary_counts(
    rows: DataFrame, tolerances: Sequence[float], block_seconds: float = BLOCK_SECONDS
) -> DataFrame:
    """(utt, b_ref, b_hyp, tp/fp/fn per tolerance tag) of long recordings."""
    bounds = cut(boundary_rows(rows), "bounds")
    counts = bounds.groupBy("utt").agg(
        F.count_if(F.col("side") == "ref").cast("int").alias("b_ref"),
        F.count_if(F.col("side") == "hyp").cast("int").alias("b_hyp"),
    )
    for tag, tolerance in tolerance_tags(tolerances).items():
        counts = counts.join(blocked_hits(bounds, tolerance, block_seconds), "utt", "left")
        tp = "CAST(coalesce(tp, 0) AS INT)"
        counts = counts.selectExpr(
            *[c for c in counts.columns if c != "tp"],
            f"{tp} AS tp_{tag}",
            f"b_hyp - {tp} AS fp_{tag}",
            f"b_ref - {tp} AS fn_{tag}",
        )
    return counts


def score_large(
    big: DataFrame,
    tolerances: Sequence[float],
    order: str,
    tile: int = TILE,
    block_seconds: float = BLOCK_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """(per-recording counts, error rows) of long recordings."""
    rows = long_rows(big, order)
    pairs = tiled_pairs(rows.select("utt", "side", "pos", "phoneme"), tile)
    errors = cut(
        large_matches(rows, pairs).selectExpr(
            "utt",
            "style",
            "ref_idx",
            "hyp_idx",
            "r.phoneme AS phoneme",
            *[f"{e} AS {n}" for n, e in boundary_errors().items()],
        ),
        "errors",
    )
    sizes = rows.groupBy("utt", "file", "style").agg(
        F.count_if(F.col("side") == "ref").cast("int").alias("n_ref"),
        F.count_if(F.col("side") == "hyp").cast("int").alias("n_hyp"),
    )
    counts = sizes.join(large_edit_counts(rows, tile, pairs), "utt").join(
        large_boundary_counts(rows, tolerances, block_seconds), "utt"
    )
    return cut(counts, "counts"), errors
