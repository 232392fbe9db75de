"""Training tables: rows, vocabulary, label encoding, length filters, resumable chunks, corpus error rate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from segmark.functions import text
from segmark.operators.scan import with_row_index
from segmark.session import cut
from segmark.sources.tables import with_file_order

# Fixed values.
UNK, PAD = "[UNK]", "[PAD]"
SAMPLE_RATE = 16_000
CHUNK_SIZE = 50_000
IGNORED_LABEL = -100

#: Largest vocabulary that is broadcast.
MAX_VOCABULARY = 100_000


def training_rows(
    table: DataFrame, clips_dir: str, path_col: str = "path", phonemes_col: str = "phonemes"
) -> DataFrame:
    """Rows with a transcription: ``audio`` path and ``phonemes``; other columns stay.

    An absolute path stays as it is.
    """
    for column in (path_col, phonemes_col):
        if column not in table.columns:
            raise ValueError(f"{column!r} not in {table.columns}")
    base = clips_dir if clips_dir.endswith("/") or not clips_dir else clips_dir + "/"
    path = F.col(path_col)
    audio = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base), path))
    rest = [c for c in table.columns if c not in (path_col, phonemes_col)]
    return table.filter(text.strip(F.col(phonemes_col)) != "").select(
        *rest, audio.alias("audio"), F.col(phonemes_col).alias("phonemes")
    )


def load_split(table: DataFrame, clips_dir: str, path_col: str, phonemes_col: str) -> DataFrame:
    """As :func:`training_rows` for a CSV read with its splits; rows are numbered after blank ones are gone."""
    return with_file_order(training_rows(table, clips_dir, path_col, phonemes_col))


def head_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in file order; None or 0 keeps all."""
    return rows.filter(F.col("row_idx") < limit) if limit else rows


def build_vocab(strings: DataFrame, column: str = "phonemes") -> DataFrame:
    """Distinct tokens in code-point order with ids from 0, then the unknown and padding tokens."""
    distinct = strings.select(F.explode(text.tokens(F.col(column))).alias("token")).distinct()
    # Blocks by leading characters: ids need a total order but no single-task sort.
    ranked = with_row_index(
        cut(distinct, "vocab"), [], ["token"], F.substring("token", 1, 2), "id", write=False
    ).select("token", F.col("id").cast("int").alias("id"))
    # An unknown token already in the data keeps its row count, so padding moves up by one only if it is new.
    new_unk = 1 - F.coalesce(F.max((F.col("token") == UNK).cast("int")), F.lit(0))
    specials = ranked.agg(F.count("*").cast("int").alias("n"), new_unk.cast("int").alias("new_unk")).select(
        F.inline(
            F.array(
                F.struct(F.lit(UNK).alias("token"), F.col("n").alias("id")),
                F.struct(F.lit(PAD).alias("token"), (F.col("n") + F.col("new_unk")).alias("id")),
            )
        )
    )
    plain = ranked.filter(~F.col("token").isin(UNK, PAD))
    return plain.unionByName(specials)


def encode_labels(rows: DataFrame, vocab: DataFrame, key: str = "row_idx") -> DataFrame:
    """Add ``labels``: token ids of ``phonemes`` in order, unknown tokens as the unknown id."""
    facts = vocab.agg(F.count("*").alias("n"), F.max(F.when(F.col("token") == UNK, F.col("id"))).alias("unk")).first()
    words = vocab.select("token", "id")
    if facts["n"] <= MAX_VOCABULARY:
        # Small enough for every task: rows are coded where they lie.
        return rows.withColumn("labels", _coder(words.collect(), facts["unk"])(text.tokens(F.coalesce("phonemes", F.lit("")))))
    # A larger vocabulary joins by shuffle, where AQE splits hot tokens.
    spread = rows.select(key, F.posexplode(text.tokens(F.col("phonemes"))).alias("k", "token"))
    known = F.coalesce("id", F.lit(facts["unk"])).cast("int").alias("id")
    ids = F.sort_array(F.collect_list(F.struct("k", known)))
    coded = spread.join(words, "token", "left").groupBy(key).agg(ids["id"].alias("labels"))
    empty = F.array().cast("array<int>")
    return rows.join(coded, key, "left").withColumn("labels", F.coalesce("labels", empty))


def _coder(words: list, unknown: int | None):
    """A function of token lists: the id of each token, or ``unknown``."""
    tokens, ids = pa.array([w["token"] for w in words], pa.string()), pa.array([w["id"] for w in words], pa.int32())

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def code(lists: pa.Array) -> pa.Array:
        found = ids.take(pc.index_in(lists.flatten(), value_set=tokens))
        found = found if unknown is None else pc.fill_null(found, pa.scalar(unknown, pa.int32()))
        offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), found)

    return code


def length_bounds(min_s: float, max_s: float, rate: int = SAMPLE_RATE) -> tuple[int, int]:
    return int(min_s * rate), int(max_s * rate)


def filter_by_length(rows: DataFrame, min_s: float = 1.0, max_s: float = 30.0) -> DataFrame:
    """Keep rows strictly between the bounds (samples)."""
    low, high = length_bounds(min_s, max_s)
    return rows.filter((F.col("input_length") > low) & (F.col("input_length") < high))


#: Folder of the commit log beside the chunks; readers of the chunks pass over names with an underscore.
COMMITS = "_commits"


def with_chunk_id(rows: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Chunk of a row by its position before any length filter."""
    return rows.withColumn("chunk_id", F.floor(F.col("row_idx") / chunk_size).cast("int"))


def _read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def committed_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """(chunk_id, n) of the chunks that are done, or None when there is no log yet."""
    return _read_if_any(spark, f"{path.rstrip('/')}/{COMMITS}")


def write_chunks(
    rows: DataFrame, path: str, chunk_size: int = CHUNK_SIZE, min_s: float = 1.0, max_s: float = 30.0, together: int | None = None
) -> None:
    """Write prepared rows chunk by chunk, skipping chunks that are done.

    Chunks are partitions. A chunk is done once it stands in the commit log beside them, which is written after its
    rows; a chunk that the length filter empties has a record too and is not looked at again. What a run that died
    left without a record is replaced. ``together``: chunks written and committed by one job (all of them by default).
    """
    spark = rows.sparkSession
    chunked = with_chunk_id(rows, chunk_size)
    done = committed_chunks(spark, path)
    if done is not None:
        chunked = chunked.join(F.broadcast(done.select("chunk_id").distinct()), "chunk_id", "left_anti")  # one row for each chunk
    if together:
        chunked = cut(chunked, "chunks")
        ends = chunked.agg(F.min("chunk_id"), F.max("chunk_id")).first()
        firsts = range(ends[0], ends[1] + 1, together) if ends[0] is not None else ()
        parts = [chunked.filter(F.col("chunk_id").between(k, k + together - 1)) for k in firsts]
    else:
        parts = [chunked]
    for part in parts:
        kept = filter_by_length(part, min_s, max_s)
        # Written once, so that rows and records are of the same chunks.
        counts = part.select("chunk_id").distinct().join(kept.groupBy("chunk_id").agg(F.count("*").alias("n")), "chunk_id", "left")
        counts = cut(counts.select("chunk_id", F.coalesce("n", F.lit(0)).alias("n")), "chunk-counts")
        chunks, n = counts.agg(F.count("*"), F.sum("n")).first()
        if not chunks:
            continue
        if n:
            kept.repartition("chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)
        counts.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{COMMITS}")


def write_once(rows: DataFrame, path: str) -> None:
    """Write an evaluation split unless it is there already."""
    if _read_if_any(rows.sparkSession, path) is None:
        rows.write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All prepared chunks; order by ``row_idx`` where order matters."""
    table = _read_if_any(spark, path)
    if table is None:
        raise FileNotFoundError(f"no chunk under {path}")
    return table


def vocab_size(vocab: DataFrame, labels: DataFrame) -> DataFrame:
    """Highest label id seen (floor 0, empty arrays ignored) and the head size that covers it."""
    seen = labels.agg(F.max(F.array_max("labels")).alias("seen"), F.lit(None).cast("int").alias("known"))
    known = vocab.agg(F.lit(None).cast("int").alias("seen"), F.max("id").cast("int").alias("known"))
    both = seen.unionByName(known).agg(
        F.greatest(F.coalesce(F.max("seen"), F.lit(0)), F.lit(0)).alias("observed_max"),
        F.coalesce(F.max("known"), F.lit(-1)).alias("known_max"),
    )
    return both.select("observed_max", (F.greatest("observed_max", "known_max") + 1).alias("vocab_size"))


def collapse_ids(ids: Column, pad_id: int) -> Column:
    """Predicted ids without repeats, then without padding."""
    kept = F.filter(ids, lambda x, i: (i == 0) | (x != F.try_element_at(ids, F.greatest(i, F.lit(1)))))
    return F.array_remove(kept, pad_id)


def _as_text(ids: Column) -> Column:
    # One code point per id (surrogates left out), so the built-in levenshtein counts id edits.
    def point(x: Column) -> Column:
        code = x + 0x20
        return F.lpad(F.hex(F.when(code < 0xD800, code).otherwise(code + 0x800)), 8, "0")

    return F.decode(F.unhex(F.array_join(F.transform(ids, point), "")), "UTF-32")


def corpus_error_rate(predictions: DataFrame, pad_id: int) -> DataFrame:
    """Pooled error rate of predicted ids against labels; 1.0 when no reference is left.

    Ignored label positions count as padding; predictions are collapsed, labels are not grouped; rows
    with an empty reference are dropped.
    """
    labels = F.transform("labels", lambda x: F.when(x == IGNORED_LABEL, pad_id).otherwise(x))
    pairs = predictions.select(
        F.array_remove(labels, pad_id).alias("r"), collapse_ids(F.col("predicted"), pad_id).alias("h")
    ).filter(F.size("r") > 0)
    sums = pairs.agg(
        F.sum(F.levenshtein(_as_text(F.col("r")), _as_text(F.col("h")))).alias("e"), F.sum(F.size("r")).alias("n")
    )
    return sums.select(F.coalesce(F.try_divide("e", "n"), F.lit(1.0)).alias("per"))
