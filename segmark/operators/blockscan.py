"""Sequential folds over long recordings, run block by block in parallel.

Some rules (greedy matching, cutting, packing) carry a state along a recording, so a block depends on
all blocks before it. All blocks are folded at once from a guessed incoming state; blocks whose guess
differs from what their predecessor really hands over are folded again, until none is left. Block k is
right after at most k + 1 rounds, in practice after two or three because such states forget quickly.
A recording of one block needs one round. No task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmark.session import cut


def fold_blocks(
    blocks: DataFrame,
    keys: Sequence[str],
    fold: Callable[[DataFrame], DataFrame],
    state_type: str,
    single: bool = False,
) -> DataFrame:
    """Fold every block with its true incoming state.

    ``blocks`` has one row per (keys, blk) with the block's content in arrays. ``fold`` adds ``out`` and
    ``state_out`` to rows that carry a ``state_in`` column (NULL: nothing before). ``single`` says that
    no recording has more than one block; then one lazy pass is all.
    """
    content = list(blocks.columns)
    first = fold(blocks.withColumn("state_in", F.lit(None).cast(state_type)))
    if single:
        return first
    done = cut(first, "fold")
    at = [*keys, "blk"]
    before = Window.partitionBy(*keys).orderBy("blk")
    while True:
        # Only keys and states meet in a window; block contents move for the blocks that are folded again.
        states = done.select(*at, "state_in", F.lag("state_out").over(before).alias("want"))
        stale = cut(states.filter(~F.col("state_in").eqNullSafe(F.col("want"))).select(*at, "want"), "stale")
        if stale.isEmpty():
            return done
        again = done.select(*content).join(stale, at).withColumnRenamed("want", "state_in")
        done = cut(done.join(stale, at, "left_anti").unionByName(fold(again)), "fold")
