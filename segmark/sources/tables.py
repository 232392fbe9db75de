"""Delimited tables read with their file order, and JSON maps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_file_order(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number rows as they stand in their files (files in path order), densely from 0.

    File order is no property of a DataFrame, so it is fixed at the scan: rows of one input split keep
    consecutive ids, and splits are ordered by (file, offset). No sort of the rows takes place; only the
    table of splits is scanned.
    """
    columns = [c for c in df.columns if c not in ("__f", "__o")]
    tagged = df.withColumn("__id", F.monotonically_increasing_id())
    splits = tagged.groupBy("__f", "__o").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__f", "__o").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "__f", "__o", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")
    )
    return tagged.join(starts, ["__f", "__o"]).select(
        *columns, (F.col("__id") - F.col("__first") + F.col("__base")).alias(name)
    )


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV file with a header; every value stays text (``NA`` too), empty cells are empty strings.

    Hidden columns ``__f`` and ``__o`` name the input split, for :func:`with_file_order`.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("nullValue", "\x00")
        .option("emptyValue", "")
        .option("multiLine", multiline)
        .csv(path)
    )
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns]
    return raw.select(
        *cells, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__o")
    )


def read_group_rows(spark: SparkSession, path: str) -> DataFrame:
    """Group metadata lines with ``line_no`` in file order."""
    return with_file_order(read_csv(spark, path), "line_no")


def read_label_map(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object label -> phoneme (configuration sized)."""
    mapping = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(mapping, dict):
        raise ValueError(f"{path}: expected a JSON object label -> phoneme")
    return mapping


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary JSON {token: id} as rows."""
    parsed = F.from_json("value", "map<string,int>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("token", "id"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Write a vocabulary as one JSON object."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "id"))))
    vocab.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)
