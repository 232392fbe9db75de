"""Files by path inside tasks: listing and reading through Arrow's file systems."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from segmark.session import cut_path


def locate(path: str):
    """(file system, name in it) of a plain path or a URL; blanks, ``#`` and ``%`` in names stand for themselves."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, name = rest[2:].partition("/")
    return fs.FileSystem.from_uri(f"{scheme}://{host}/{quote(name)}")


#: Entries of a folder that a listing task gives on at once.
SLICE = 10_000


def _entries(given: str) -> Iterator[tuple[str, bool]]:
    """(path, is it a folder) of what lies in a folder; links back to a folder above are not followed."""
    from pyarrow import fs

    store, name = locate(given)
    head = given[: len(given) - len(name)] if given.endswith(name) else given.partition("://")[0] + "://"
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(name) as found:  # gives entries one by one, however many there are
            for e in found:
                if e.is_dir():
                    if not (e.is_symlink() and f"{os.path.realpath(name)}/".startswith(f"{os.path.realpath(e.path)}/")):
                        yield head + e.path, True
                elif e.is_file():
                    yield head + e.path, False
        return
    for i in store.get_file_info(fs.FileSelector(name, recursive=False)):
        if i.type in (fs.FileType.File, fs.FileType.Directory):
            yield head + i.path, i.type == fs.FileType.Directory


def list_paths(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Paths of all files under ``folder``, whatever their names.

    The tree is listed level by level: the folders found on one level are dealt out anew and each is listed by one
    task, which gives entries on in slices of bounded size. Every level is written before the next one reads it, so a
    deep tree, a wide one and a single folder with all files take the same path.
    """
    def below(batches):
        for b in batches:
            for given in b.column(0).to_pylist():
                found = _entries(given)
                while part := list(islice(found, SLICE)):
                    paths, kinds = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds)], names=["path", "is_dir"])

    schema = "path string, is_dir boolean"
    root, levels = cut_path(spark, "listing"), []
    frontier = spark.createDataFrame([(folder.rstrip("/") or "/",)], "path string")
    while True:
        levels.append(f"{root}/level={len(levels)}")
        frontier.mapInArrow(below, schema).write.parquet(levels[-1])
        folders = spark.read.schema(schema).parquet(levels[-1]).filter("is_dir").select("path")
        if not recursive or folders.isEmpty():
            break
        frontier = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    return spark.read.schema(schema).parquet(*levels).filter("not is_dir").select("path")


def read_bytes(path: str) -> bytes:
    store, name = locate(path)
    with store.open_input_stream(name) as f:
        return f.read()


def write_bytes(path: str, body: bytes) -> None:
    store, name = locate(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(body)
