"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model is compiled into one transducer: the normaliser (blanks become the mark U+2581, one is put in front), the
pieces as paths through a prefix tree, and for characters without a piece their bytes. Its state remembers the last
piece, and an arc exists only between two pieces that the merges would leave next to each other; arcs are made
when a text first needs them. A sequence of pieces is what the merges of a model of this kind give exactly if every
two neighbours are, so the tropical shortest path through the composition with a text (arcs weigh the piece's
negated score) is the model's encoding. No piece has the mark after another character, so words are composed one by
one, each distinct word of a worker once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmark.llm.common import free_name, kept_in_worker, numbers, ranges, text_rows

MARK = "▁"
#: Bytes of texts and ids that a worker keeps from one batch to the next (as much again is forgotten last), and arcs.
MOST_KEPT, MOST_ARCS = 90 << 20, 500_000
#: What a kept text takes besides its characters and ids.
ENTRY = 210
#: Rows that a task works on together.
SLICE = 1000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    """``words`` gives the ids of words, ``encode`` those of texts, ``decode`` the text of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for key, value in model:
            if key == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif key == 2:
                trainer = dict(fields(value))
            elif key == 3:
                normalizer = dict(fields(value))
        kinds = {k for _, _, k in self.pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35) or USER in kinds or UNUSED in kinds:
            raise ValueError("only models of merged pieces with byte fallback are compiled")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only the identity normaliser that marks and adds a blank, and keeps the others, is compiled")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a blank inside")
        # Of each character: the piece that ends with it (-1: none) and what goes on from there.
        self.tree: dict = {}
        for p, i in self.ids.items():
            node, at = self.tree, None
            for c in p:
                at = node.setdefault(c, [-1, {}])
                node = at[1]
            at[0] = i
        self.arcs: dict[int, bool] = {}
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = 0
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.lines_end = not any("\n" in p for p in self.ids)
        out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.out, self.out_size = np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out])
        self.out_at = np.cumsum(self.out_size) - self.out_size

    def merged(self, text: str) -> list[str]:
        """What the merges leave: of all neighbours that make a piece, those with the best score first, leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.pieces[i][1] > best):
                    best, at = self.pieces[i][1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joins(self, arc: int, left: str, right: str) -> bool:
        """Whether there is an arc for ``right`` out of the state ``left``; kept under the number ``arc``."""
        if len(self.arcs) > MOST_ARCS:
            self.arcs.clear()
        known = self.arcs[arc] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def paths(self, texts: list[str]) -> Iterator[list[int]]:
        """For each of ``texts``, which are sorted, the states on the shortest path through its composition.

        The merges leave one sequence for each beginning of a text, so one state at most is alive behind each
        character; should arcs of several meet, the lighter one stays. States are numbered: 0 at the beginning, then
        the pieces, then the characters that have none. What a text has in common with the one before is not walked
        again.
        """
        arcs, pieces, count, tree = self.arcs, self.pieces, len(self.pieces) + 1, self.tree
        state: list[int | None] = [0]
        cost, begin = [0.0], [0]
        ways: list[list] = [[]]  # behind each character: where in the tree the pieces begun before it stand
        last = ""
        for text in texts:
            n, same = len(text), 0
            for x, y in zip(last, text):
                if x != y:
                    break
                same += 1
            del state[same + 1 :], cost[same + 1 :], begin[same + 1 :], ways[same + 1 :]
            for j in range(same, n):
                c, on = text[j], []
                best, weight, origin, single = None, 0.0, 0, False
                started = ways[j] if state[j] is None else [*ways[j], (tree, j)]
                for node, i in started:
                    step = node.get(c)
                    if step is None:
                        continue
                    known, node = step
                    if node:
                        on.append((node, i))
                    if known < 0:
                        continue
                    if i == j:
                        single = True
                    number = state[i] << 21 | known + 1
                    arc = arcs.get(number)
                    if arc is None:
                        arc = self.joins(number, text[begin[i] : i], text[i : j + 1])
                    if arc:
                        total = cost[i] - pieces[known][1]
                        if best is None or total < weight:
                            best, weight, origin = known + 1, total, i
                if best is None and not single and state[j] is not None:
                    known = count + ord(c)
                    number = state[j] << 21 | known
                    arc = arcs.get(number)
                    if arc if arc is not None else self.joins(number, text[begin[j] : j], c):
                        best, weight, origin = known, cost[j], j  # goes out as bytes
                state.append(best)
                cost.append(weight)
                begin.append(origin)
                ways.append(on)
            out, at = [], n
            while at:
                out.append(state[at])
                at = begin[at]
            last = text
            yield out[::-1]

    def path(self, text: str) -> list[str]:
        """The shortest path through the composition with ``text``, as the texts of its pieces."""
        count = len(self.pieces)
        return [self.pieces[s - 1][0] if s <= count else chr(s - count - 1) for s in next(self.paths([text]))]

    def learn(self, texts: set[str]) -> None:
        """Keeps the ids of ``texts``; what isn't asked for until as much again has come is forgotten."""
        count, new = len(self.pieces), sorted(texts)
        for text, states in zip(new, self.paths(new)):
            ids: list[int] = []
            for s in states:
                if s <= count:
                    ids.append(s - 1)
                else:
                    ids += [self.bytes[b] for b in chr(s - count - 1).encode()]
            self.keep(text, np.array(ids, "<u4").tobytes())

    def keep(self, text: str, ids: bytes) -> None:
        self.segments[text] = ids
        self.kept += ENTRY + 2 * len(text) + len(ids)

    def parts(self, word: str) -> list[str]:
        """``word`` cut at line ends and before its last character, where no piece has the two sides side by side."""
        out = []
        for k, line in enumerate(word.split("\n") if self.lines_end else [word]):
            if k:
                out.append("\n")
            if line[-2:] in self.inside or len(line) < 2:
                out.append(line)
            else:
                out += (line[:-1], line[-1])
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words, the mark in front; those of their parts are kept for the next time."""
        if self.kept > MOST_KEPT:
            self.older, self.segments, self.kept = self.segments, {}, 0
        segments, older, inside = self.segments, self.older, self.inside
        cut, new = [], set()
        for word in words:
            line = MARK + word
            if "\n" in word:
                own = self.parts(line)
            elif line[-2:] in inside or len(line) < 2:
                own = (line,)
            else:
                own = (line[:-1], line[-1])
            for part in own:
                if part not in segments:
                    ids = older.get(part)
                    if ids is None:
                        new.add(part)
                    else:
                        self.keep(part, ids)
            cut.append(own)
        self.learn(new)
        return [segments[own[0]] if len(own) == 1 else b"".join([segments[part] for part in own]) for own in cut]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        if not len(texts):
            return []
        odd = np.asarray(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, MARK))))
        full = np.asarray(pc.greater(pc.binary_length(texts), 0))
        groups = [(np.flatnonzero(~odd & full), None), (np.flatnonzero(odd & full), True)]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for rows, runs in groups:
            own = texts.take(pa.array(rows))
            if runs:  # several blanks together are one word's beginning
                lists = pa.array([[u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK))] for t in own.to_pylist()], pa.list_(pa.string()))
            else:
                lists = pc.split_pattern(own, " ")
            coded = lists.flatten().dictionary_encode()
            parts = self.words(coded.dictionary.to_pylist())
            ids, lengths = np.frombuffer(b"".join(parts), "<u4").astype(np.int64), np.array([len(p) // 4 for p in parts], np.int64)
            which = numbers(coded.indices)
            ids = ids[ranges((np.cumsum(lengths) - lengths)[which], lengths[which])]
            ends = np.append(0, np.cumsum(lengths[which]))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for r, a, b in zip(rows.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[r] = ids[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: pieces and bytes put together, marks as blanks, the one put in front taken off."""
        raw = self.out[ranges(self.out_at[ids], self.out_size[ids])].tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def transducer(path: str) -> Transducer:
    return kept_in_worker(("transducer", path), lambda: Transducer(path))


def lists_of(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` with the ids of the whole text (null or empty: no ids), and that column's name."""
    name, at = free_name(docs.columns, column), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                some = b.slice(k, SLICE)
                ids = transducer(path).encode(pc.fill_null(some.column(at), ""))
                yield pa.RecordBatch.from_arrays([*some.columns, lists_of(ids)], names=[f.name for f in schema.fields])

    return text_rows(docs).mapInArrow(add, schema), name


def decode(tokens: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> tuple[DataFrame, str]:
    """All rows and columns of ``tokens`` with the text of their ids (null: the empty text), and that column's name.

    Bytes that aren't valid UTF-8 become U+FFFD; control pieces have no text; ids outside the model are an error.
    """
    name, at = free_name(tokens.columns, column), tokens.columns.index(ids)
    schema = T.StructType([*tokens.schema.fields, T.StructField(name, T.StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                some = b.slice(k, SLICE)
                texts = [transducer(path).decode(np.asarray(x.values, dtype=np.int64)) if x.is_valid and len(x) else "" for x in some.column(at)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return text_rows(tokens).mapInArrow(add, schema), name


def round_trip(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` with a struct (ids, ids_crc32, decoded), and that column's name.

    One pass does what ``encode`` and ``decode`` do one after the other; the checksum is that of the ids as
    little-endian unsigned 32-bit numbers.
    """
    name, at = free_name(docs.columns, "tokens"), docs.columns.index(text)
    kind = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("ids_crc32", "long").add("decoded", "string")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                some = b.slice(k, SLICE)
                ids = own.encode(pc.fill_null(some.column(at), ""))
                columns = [lists_of(ids), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.string())]
                struct = pa.StructArray.from_arrays(columns, names=["ids", "ids_crc32", "decoded"])
                yield pa.RecordBatch.from_arrays([*some.columns, struct], names=[f.name for f in schema.fields])

    return text_rows(docs).mapInArrow(add, schema), name
