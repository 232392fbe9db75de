"""Annotation and timeline files as Spark formats: ``spark.read.format(...)``, ``df.write.format(...)`` and SQL's ``USING``.

Formats are registered per session with :func:`register`:

* ``segmark_textgrid`` reads intervals of a chosen tier, one file at a time, in slices of a listing.
* ``segmark_etf`` writes and reads detection timelines. What a task writes counts only once the job commits.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from segmark.functions import presets
from segmark.session import cut_path
from segmark.sources import stores
from segmark.sources.textgrid import DEFAULT_TIER_NAMES, TierChoice, text_of

#: Rows that a reader gives on at once.
ROWS = 10_000

COLUMNS = {"path": T.StringType(), "pos": T.IntegerType(), "label": T.StringType(), "start_s": T.DoubleType(), "end_s": T.DoubleType(), "error": T.StringType()}
ARROW = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}

_TOKEN = re.compile(r'"((?:[^"]|"")*)"|(?<!\S)([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?!\S)', re.ASCII)
_COUNT = re.compile(r"[-+]?\d{1,9}", re.ASCII)


def tokens_of(content: str) -> list[tuple[bool, str]]:
    """(is it quoted, its text) of each free-standing number and quoted string."""
    return [(m[1] is not None, m[1].replace('""', '"') if m[1] is not None else m[2]) for m in _TOKEN.finditer(content)]


def tier_starts(tokens: list[tuple[bool, str]]) -> list[int]:
    """Where each tier begins; the counts must lead exactly to the end of the file."""
    def count(at: int) -> int:
        quoted, value = tokens[at]
        if quoted or not _COUNT.fullmatch(value) or int(value) < 0:
            raise ValueError
        return int(value)

    try:
        if tokens[1] != (True, "TextGrid"):
            raise ValueError
        starts, at = [], 5
        for _ in range(count(4)):
            starts.append(at)
            at += 5 + {"IntervalTier": 3, "TextTier": 2}[tokens[at][1]] * count(at + 4)
        if starts and at != len(tokens):
            raise ValueError
    except (ValueError, IndexError, KeyError):
        raise ValueError("not a readable TextGrid") from None
    return starts


def chosen(names: list[str], choice: TierChoice) -> int:
    """Position of the tier that ``choice`` means (see :class:`TierChoice`)."""
    if not names:
        raise ValueError("TextGrid has no tiers")
    if choice.tier is not None:
        if choice.tier not in names:
            raise KeyError(f"tier {choice.tier!r} is missing")
        return names.index(choice.tier)
    low = [n.lower() for n in names]
    if choice.contains is not None:
        hits = [i for i, n in enumerate(low) if choice.contains.lower() in n]
        if hits:
            return hits[0]
        if choice.index is None:
            raise KeyError(f"no tier name contains {choice.contains!r}")
    if choice.index is not None:
        if not -len(names) <= choice.index < len(names):
            raise IndexError("list index out of range")
        return choice.index % len(names)
    last = {n: i for i, n in enumerate(low)}  # names equal but for case: the last one counts
    return next((last[n] for n in DEFAULT_TIER_NAMES if n in last), 0)


def intervals_of(content: str, choice: TierChoice) -> Iterator[tuple[int, str, float, float]]:
    """(pos, label, start, end) of the chosen tier, labels without outer blanks, blank ones included."""
    tokens = tokens_of(content)
    starts = tier_starts(tokens)
    names: list[str] = []
    given = [tokens[s + 1][1] for s in starts]
    for i, n in enumerate(given):
        before = given[:i].count(n)
        names.append(f"{n}_{before + 1}" if choice.rename_duplicates and before else n)
    start = starts[chosen(names, choice)]
    if tokens[start][1] != "IntervalTier":
        raise ValueError("the chosen tier holds points")
    for pos in range(int(tokens[start + 4][1])):
        (no_a, a), (no_z, z), (label_is, label) = tokens[start + 5 + 3 * pos : start + 8 + 3 * pos]
        if no_a or no_z or not label_is:
            raise ValueError("not a readable TextGrid")
        yield pos, label.strip(), float(a), float(z)


@dataclass
class Slice(InputPartition):
    """Rows ``first`` to ``last`` of a row group of the listing, or every ``of``-th file of a folder."""

    file: str
    group: int = 0
    first: int = 0
    last: int = 0
    part: int = 0
    of: int = 0


def files_under(folder: str) -> Iterator[str]:
    folders = [folder]
    while folders:
        for path, is_folder in stores._entries(folders.pop()):
            if is_folder:
                folders.append(path)
            else:
                yield path


class AnnotationReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        flag = lambda name: low.get(name, "true").lower() == "true"
        index = low.get("tierindex")
        self.choice = TierChoice(low.get("tier"), low.get("tiercontains"), None if index is None else int(index), flag("renameduplicates"))
        self.fields = [f.name for f in schema.fields]
        if unknown := set(self.fields) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.types = pa.schema([(f.name, ARROW[COLUMNS[f.name]]) for f in schema.fields])
        self.folder, self.listing = low.get("path"), low.get("listing")
        if (self.folder is None) == (self.listing is None):
            raise ValueError("give a path or a listing, one of them")
        self.ending = low.get("extension", ".textgrid").lower()
        self.mode = low.get("mode", "PERMISSIVE").upper()
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"unknown mode {self.mode}")
        self.per_task, self.tasks = int(low.get("filespertask", 256)), int(low.get("tasks", 16))
        self.silence = set() if not flag("removesilence") else {s.lower() for s in presets.SILENCE_LABELS}

    def partitions(self) -> list[Slice]:
        """Slices by the row counts in the listing's footers; of a bare folder nothing is listed here."""
        if self.folder is not None:
            return [Slice(self.folder.rstrip("/") or "/", part=i, of=self.tasks) for i in range(self.tasks)]
        import pyarrow.parquet as pq

        found = []
        for path in sorted(p for p in files_under(self.listing.rstrip("/")) if p.endswith(".parquet")):
            store, name = stores.locate(path)
            footer = pq.read_metadata(name, filesystem=store)
            for g in range(footer.num_row_groups):
                rows = footer.row_group(g).num_rows
                found += [Slice(path, g, k, min(k + self.per_task, rows)) for k in range(0, rows, self.per_task)]
        return found

    def paths(self, part: Slice | None) -> Iterable[str]:
        if part is None:  # an empty listing
            return ()
        if part.of:
            ours = lambda p: zlib.crc32(p.encode("utf-8", "surrogateescape")) % part.of == part.part
            return (p for p in files_under(part.file) if p.lower().endswith(self.ending) and ours(p))
        import pyarrow.parquet as pq

        store, name = stores.locate(part.file)
        with pq.ParquetFile(name, filesystem=store) as f:
            column = f.read_row_group(part.group, columns=["path"]).column(0)
        return column.slice(part.first, part.last - part.first).to_pylist()

    def rows_of(self, path: str) -> list[dict]:
        try:
            try:
                content = text_of(stores.read_bytes(path))
            except UnicodeDecodeError:
                raise ValueError("neither UTF-8 nor UTF-16 text") from None
            rows = list(intervals_of(content, self.choice))
        except Exception as exc:  # one unreadable file must not end the job
            if self.mode == "FAILFAST":
                raise
            why = f"{type(exc).__name__}: {exc.args[0] if isinstance(exc, KeyError) else exc}"
            return [{"path": path, "error": why}] if self.mode == "PERMISSIVE" else []
        return [
            {"path": path, "pos": pos, "label": label, "start_s": a, "end_s": z}
            for pos, label, a, z in rows
            if label and label.lower() not in self.silence
        ]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for path in self.paths(partition):
            held += self.rows_of(path)
            while len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held[:ROWS], schema=self.types)
                held = held[ROWS:]
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.types)


class AnnotationSource(DataSource):
    """Intervals of annotation files: (path, pos, label, start_s, end_s, error).

    ``path``: a folder, which every one of ``tasks`` (16) tasks walks for its share of the files; or ``listing``: a
    Parquet folder with a column ``path``, read in slices of ``filesPerTask`` (256), for large corpora. Options
    ``tier``, ``tierContains``, ``tierIndex``, ``renameDuplicates`` choose the tier (:class:`TierChoice`),
    ``removeSilence`` (true) drops silence, blank labels always go. ``mode`` says what becomes of a file that cannot be
    read: one row with its ``error`` (PERMISSIVE), nothing (DROPMALFORMED), the end of the job (FAILFAST). A schema
    given by the caller, any of these columns, is all that tasks hand on. A file without intervals gives no row.
    """

    @classmethod
    def name(cls) -> str:
        return "segmark_textgrid"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k) for n, k in COLUMNS.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return AnnotationReader(schema, dict(self.options))


TIMELINE = {"utt": T.StringType(), "start_s": T.DoubleType(), "duration_s": T.DoubleType(), "target": T.StringType(), "decision": T.StringType()}
# The line format.
_FIELDS = r"^(?P<utt>.*) 1 (?P<start_s>-?[0-9]+\.[0-9]{6}) (?P<duration_s>-?[0-9]+\.[0-9]{6}) sc - (?P<target>.*) - (?P<decision>[tf])$"
#: Folder of what is written but not committed.
PENDING = "_pending-"


def _six_digits(times: pa.Array) -> pa.Array:
    """Times as text; each distinct one is formatted once, and a segment comes once for every label of its recording."""
    if times.null_count:
        raise TypeError("a timeline needs the times of every segment")
    coded = times.view(pa.int64()).dictionary_encode()
    values = coded.dictionary.view(pa.float64()).to_pylist()
    return pa.array([f"{v:.6f}" for v in values], pa.string()).take(coded.indices)


def lines_of(batch: pa.RecordBatch) -> pa.StringArray:
    """Lines of a batch of timeline rows, line ends included."""
    utt, start, long, target, decision = (batch.column(batch.schema.names.index(n)) for n in TIMELINE)
    utt, target, decision = (pc.fill_null(c.cast(pa.string()), "None") for c in (utt, target, decision))
    return pc.binary_join_element_wise(utt, " 1 ", _six_digits(start), " ", _six_digits(long), " sc - ", target, " - ", decision, "\n", "")


def rows_of_lines(lines: list[bytes], path: str) -> pa.RecordBatch:
    """Timeline rows of lines without their ends."""
    text = pa.array(lines, pa.binary()).cast(pa.string())
    found = pc.extract_regex(text, _FIELDS)
    if found.null_count:
        bad = text[pc.index(found.is_null(), True).as_py()].as_py()
        raise ValueError(f"not a line of a timeline in {path}: {bad[:80]!r}")
    columns = [found.field(n) if k == T.StringType() else found.field(n).cast(pa.float64()) for n, k in TIMELINE.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(TIMELINE))


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class TimelineWriter(DataSourceArrowWriter):
    """One file for each task that has rows, in a folder of its own until the job commits.

    A task that fails removes its file, attempts never share one, and only files named in commit messages move on. With
    ``overwrite`` the former files go after the new ones stand, and with them what tasks that outlived a failed job left
    in its folder; ``_SUCCESS`` comes last.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        if {f.name: f.dataType for f in schema.fields} != TIMELINE or len(schema.fields) != len(TIMELINE):
            wanted = ", ".join(f"{n} {k.simpleString()}" for n, k in TIMELINE.items())
            raise ValueError(f"a timeline has the columns {wanted}")
        self.root, self.job, self.overwrite = dict(options)["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}-{context.taskAttemptId()}.etf"
        store, folder = stores.locate(f"{self.root}/{PENDING}{self.job}")
        out, rows = None, 0
        try:
            for b in iterator:
                lines = lines_of(b)
                if len(lines) and out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                if len(lines):
                    ends = lines.offset, lines.offset + len(lines)
                    at = np.frombuffer(lines.buffers()[1], np.int32)
                    out.write(lines.buffers()[2].slice(int(at[ends[0]]), int(at[ends[1]] - at[ends[0]])))
                rows += len(lines)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{folder}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = stores.locate(self.root)
        store.create_dir(root, recursive=True)
        found = list(stores._entries(self.root)) if self.overwrite else []  # part files, one for each task
        old = [p for p, is_folder in found if not is_folder]
        left = [p for p, is_folder in found if is_folder and p.rpartition("/")[2].startswith(PENDING)]
        for m in messages:
            if m is not None and m.name:
                store.move(f"{root}/{PENDING}{self.job}/{m.name}", f"{root}/{m.name}")
        for path in old:
            store.delete_file(stores.locate(path)[1])
        for path in {*left, f"{self.root}/{PENDING}{self.job}"}:
            self._forget(path)
        stores.write_bytes(f"{self.root}/_SUCCESS", b"")

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(f"{self.root}/{PENDING}{self.job}")

    def _forget(self, path: str) -> None:
        from pyarrow import fs

        store, folder = stores.locate(path)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


@dataclass
class Part(InputPartition):
    path: str


class TimelineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = dict(options)["path"].rstrip("/")

    def partitions(self) -> list[Part]:
        names = sorted(p for p, is_folder in stores._entries(self.root) if not is_folder and p.endswith(".etf"))
        return [Part(p) for p in names]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a timeline without lines
            return
        store, name = stores.locate(partition.path)
        with store.open_input_stream(name) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                if lines:
                    yield rows_of_lines(lines, partition.path)
            if rest:
                raise ValueError(f"the last line of {partition.path} is cut off")


class TimelineSource(DataSource):
    """Detection timelines: (utt, start_s, duration_s, target, decision), six digits of the times are kept.

    Written in the order of the rows in each task: range-partition and sort first for one timeline in file order.
    """

    @classmethod
    def name(cls) -> str:
        return "segmark_etf"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k) for n, k in TIMELINE.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TimelineReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TimelineWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnnotationSource)
    spark.dataSource.register(TimelineSource)


def read_annotations(spark: SparkSession, files: DataFrame, columns: str | None = None, **options: str) -> DataFrame:
    """Annotation files of ``files`` (path), such as ``stores.list_paths`` or a manifest gives, through the format."""
    register(spark)
    listing = cut_path(spark, "annotation-listing")
    files.select("path").write.parquet(listing)
    reader = spark.read.format(AnnotationSource.name()).option("listing", listing)
    if columns:
        reader = reader.schema(columns)
    return reader.options(**options).load()


def write_timeline(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Timeline rows as part files that together, in the order of their names, form one timeline."""
    register(rows.sparkSession)
    order = ("utt", "target", "start_s")
    dealt = rows.select(*TIMELINE).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.format(TimelineSource.name()).mode(mode).save(path)
