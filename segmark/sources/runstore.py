"""Stored runs: scored-ready intervals laid out so that scoring reads them without a shuffle.

A store is a folder with parts and a record of them. Recordings of ordinary length are bucketed by recording,
one file a bucket, so all labels of a recording lie in one task's input and a group by recording needs no
exchange. Longer ones, whose labels one task should not gather, lie beside them as plain rows. A record is
written last under the next number and names the parts: a store that is written again stays readable in its
former state until then, and a run that dies leaves no half of a store.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmark.operators.large import split_by_length
from segmark.operators.seqalign import MAX_ONE_TASK

COLUMNS = ("utt", "file", "style", "side", "pos", "phoneme", "start_s", "end_s")
#: Labels aimed at in one bucket.
BUCKET_ROWS = 1 << 22


@dataclass(frozen=True)
class StoredRun:
    """A store as read: ``short`` is bucketed by recording, ``long`` (or None) holds the recordings with more than
    ``limit`` labels on a side; ``longest`` is the largest number of labels on one side."""

    short: DataFrame
    long: DataFrame | None
    limit: int
    longest: int


def write_store(store: DataFrame, path: str, limit: int = MAX_ONE_TASK, bucket_rows: int = BUCKET_ROWS) -> None:
    """Writes intervals (:data:`COLUMNS`; further columns are left out), replacing what is there.

    The input is read twice, for the lengths and for the rows. An empty store is one with no rows.
    """
    spark, path = store.sparkSession, path.rstrip("/")
    rows = store.select(*COLUMNS)
    sizes = rows.groupBy("utt", "side").agg(F.count("*").alias("n"))
    total, longest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    short, long_ = split_by_length(rows, limit, longest)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    # Enough buckets to hold each and, while there are rows for it, to keep all cores at work.
    buckets = min(most, max(1, -(-total // bucket_rows), min(spark.sparkContext.defaultParallelism, total >> 12)))
    tag = uuid.uuid4().hex
    parts = {"short": f"short-{tag}", "long": f"long-{tag}" if long_ is not None else None}
    name = f"spark_catalog.default.run_{tag}"
    # Partitions are the buckets, so each task writes one file.
    short.repartition(buckets, "utt").write.format("parquet").bucketBy(buckets, "utt").sortBy("utt", "side", "pos").option(
        "path", f"{path}/{parts['short']}"
    ).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    if long_ is not None:
        long_.write.parquet(f"{path}/{parts['long']}")
    record = {**parts, "buckets": buckets, "limit": limit, "longest": longest, "schema": rows.schema.jsonValue()}
    former = _records(spark, path)
    _put(spark, f"{path}/_store-{former[0][0] + 1 if former else 0}.json", json.dumps(record))
    for number, old in former:
        for gone in (f"_store-{number}.json", old["short"], old["long"]):
            if gone:
                fs, where = _at(spark, f"{path}/{gone}")
                fs.delete(where, True)


def read_split(spark: SparkSession, path: str) -> StoredRun:
    """A store by its parts, the first with its bucketing."""
    path = path.rstrip("/")
    records = _records(spark, path)
    if not records:
        raise FileNotFoundError(f"{path}: no stored run")
    record = records[0][1]
    columns = ", ".join(f"`{f['name']}` {f['type']}" for f in record["schema"]["fields"])
    name = f"spark_catalog.default.run_{uuid.uuid4().hex}"
    where = f"{path}/{record['short']}".replace("\\", "\\\\").replace("'", "\\'")
    # The catalogue is the only way to tell Spark of buckets; the rows keep them once they are read by it.
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (utt) SORTED BY (utt, side, pos)"
        f" INTO {record['buckets']} BUCKETS LOCATION '{where}'"
    )
    short = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    long_ = spark.read.schema(short.schema).parquet(f"{path}/{record['long']}") if record["long"] else None
    return StoredRun(short, long_, record["limit"], record["longest"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store."""
    run = read_split(spark, path)
    return run.short if run.long is None else run.short.unionByName(run.long)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _records(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(number, record), the newest first; one that was cut off while it was written doesn't count."""
    fs, where = _at(spark, path)
    found = []
    for status in fs.listStatus(where) if fs.exists(where) else []:
        named = re.fullmatch(r"_store-(\d+)\.json", status.getPath().getName())
        if named:
            stream = fs.open(status.getPath())
            try:
                found.append((int(named[1]), json.loads(bytes(stream.readAllBytes()).decode())))
            except ValueError:
                continue
            finally:
                stream.close()
    return sorted(found, key=lambda r: -r[0])


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
