"""JSON arrays of any size, split: the borders of their elements are found in byte ranges that are scanned apart."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces of a file end here, so that Spark can split it anywhere; (inside a string, after a backslash) at a range's start.
PIECE_END = "}"
ENTRIES = [(s, e) for s in (0, 1) for e in (0, 1)]
_OPEN, _CLOSE, _COMMA, _QUOTE, _BACKSLASH = (np.frombuffer(c, np.uint8) for c in (b"[{", b"]}", b",", b'"', b"\\"))


def structure(data: np.ndarray, inside: int, escaped: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(positions of [ ] { } , outside strings, the depth after each, inside and escaped after data) of bytes of JSON that begin in
    the given state; depth counts from 0."""
    quote = data == _QUOTE[0]
    slash = np.flatnonzero(data == _BACKSLASH[0])
    if escaped and len(data):
        quote[0] = False
        slash = slash[1:] if len(slash) and slash[0] == 0 else slash
        escaped = 0
    if len(slash):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(slash) > 1]))
        length = np.diff(np.append(starts, len(slash)))
        after = (slash[starts] + length)[length % 2 == 1]  # what follows an odd run is escaped
        escaped = int(len(after) > 0 and after[-1] == len(data))
        quote[after[after < len(data)]] = False
    within = (np.cumsum(quote) + inside) & 1
    outside = within == 0
    step = np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8)
    at = np.flatnonzero(outside & ((step != 0) | (data == _COMMA[0])))
    return at, np.cumsum(step[at], dtype=np.int64), int(within[-1]) if len(data) else inside, escaped


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, np.ndarray]]:
    """((file, range's start), whether it is the range's first, bytes), in order."""
    last = None
    for b in batches:
        keys = zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True)
        for key, rows in groupby(enumerate(keys), key=lambda r: r[1]):
            which = [i for i, _ in rows]
            parts = [v.as_py() for v in b.column("value").slice(which[0], len(which))]
            data = PIECE_END.encode().join(parts)
            if not (key != last and key[1] == 0):
                data = PIECE_END.encode() + data
            yield key, key != last, np.frombuffer(data, np.uint8)
            last = key


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges -> what each does to a scan: for every state at its start, the state and depth at its end and its commas by
    depth. Such functions put together are functions again, so ranges need not wait for each other."""
    found: dict[tuple, dict] = {}
    size: Counter = Counter()
    for key, _, data in _pieces(batches):
        now = found.setdefault(key, {e: [*e, 0, Counter()] for e in ENTRIES})
        size[key] += len(data)
        seen: dict[tuple, tuple] = {}
        for state in now.values():
            inside, escaped, depth, commas = state
            if (inside, escaped) not in seen:
                at, deep, i, e = structure(data, inside, escaped)
                level, often = np.unique(deep[data[at] == _COMMA[0]], return_counts=True)
                seen[inside, escaped] = (i, e, int(deep[-1]) if len(deep) else 0, dict(zip(level.tolist(), often.tolist(), strict=True)))
            i, e, down, more = seen[inside, escaped]
            commas.update({depth + k: v for k, v in more.items()})
            state[:3] = i, e, depth + down
    rows = [(k[0], k[1], size[k], json.dumps([[*s[:3], list(s[3].items())] for s in v.values()])) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "block", "size", "ends"])


def _begun(ranges: list) -> dict[tuple[str, int], tuple[int, int, int, int]]:
    """(file, start) -> (inside, escaped, depth, elements before) of ranges that don't begin a file."""
    out = {}
    for file, own in groupby(sorted(ranges, key=lambda r: (r.file, r.block)), key=lambda r: r.file):
        state, before, size = [0, 0, 0], 0, 0
        for r in own:
            if r.block:
                out[file, r.block] = (*state, before)
            inside, escaped, down, commas = json.loads(r.ends)[ENTRIES.index((state[0], state[1]))]
            before += sum(n for level, n in commas if state[2] + level == 1)
            state, size = [inside, escaped, state[2] + down], size + r.size
        if state != [0, 0, 0] or size != r.file_size:
            raise ValueError(f"{file} is not one JSON array")
    return out


ELEMENTS = "file string, seq long, block long, whole boolean, closed boolean, line string"


def _elements(begun: dict):
    """Byte ranges -> their elements; the first and the last one of a range may go on in others."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())

    class Range:
        def __init__(self, key: tuple[str, int], alone: bool, file_size: int):
            self.key, self.alone, self.left, self.held, self.rows = key, alone, file_size, [], []
            self.inside, self.escaped, self.depth, self.seq = begun.get(key, (0, 0, 0, 0))
            self.begun_before, self.over = self.depth > 0, False

        def fail(self) -> None:
            raise ValueError(f"{self.key[0]} is not one JSON array")

        def put(self, closed: bool, ended: bool = True) -> None:
            text = b"".join(self.held).decode("utf-8")
            self.held = []
            whole = ended and not self.begun_before
            if whole and not text.strip():
                if not closed or self.seq:
                    self.fail()
                return
            self.rows.append((*self.key[:1], self.seq, self.key[1], whole, closed, text))

        def feed(self, data: np.ndarray) -> None:
            self.left -= len(data)
            at, deep, inside, escaped = structure(data, self.inside, self.escaped)
            deep = deep + self.depth
            char = data[at]
            border = ((char == _COMMA[0]) & (deep == 1)) | (np.isin(char, _CLOSE) & (deep == 0)) | (np.isin(char, _OPEN) & (deep == 1))
            raw, start = data.tobytes(), 0
            now = int(self.depth > 0)  # within the array
            for p, d in zip(at[border].tolist(), deep[border].tolist(), strict=True):
                c = raw[p : p + 1]
                if c == b"[" and d == 1 and now == 0:
                    if raw[start:p].strip() or self.over:
                        self.fail()
                    self.seq, now, start = 0, 1, p + 1
                elif c in (b",", b"]") and now == 1:
                    self.held.append(raw[start:p])
                    self.put(c == b"]")
                    self.begun_before, start = False, p + 1
                    if c == b"]":
                        now, self.over = 0, True
                    else:
                        self.seq += 1
                elif c == b"[" and d == 1 or c not in (b"[", b"{"):
                    self.fail()
                elif c == b"{" and now == 0:
                    self.fail()
            rest = raw[start:]
            if now:
                self.held.append(rest)
            elif rest.strip():
                self.fail()
            self.inside, self.escaped, self.depth = inside, escaped, int(deep[-1]) if len(deep) else self.depth

        def end(self) -> None:
            if self.depth > 0:
                if self.alone:
                    self.fail()
                self.put(False, False)
            elif self.alone and (not self.over or self.inside or self.left == len(PIECE_END)):  # a last brace ends a piece
                self.fail()

        def batch(self) -> pa.RecordBatch:
            rows, self.rows = self.rows, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], [c.split()[0] for c in ELEMENTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        known: dict[str, tuple[bool, int]] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                known.update(zip(b.column("file").to_pylist(), zip(b.column("whole").to_pylist(), b.column("file_size").to_pylist(), strict=True), strict=True))
                yield b

        for key, first, data in _pieces(noted()):
            if first:
                if now:
                    now.end()
                    yield now.batch()
                now = Range(key, *known[key[0]])
            now.feed(data)
            if len(now.rows) >= 1000:
                yield now.batch()
        if now:
            now.end()
            yield now.batch()

    return run


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, line: the elements, as text, of files that are one JSON array each.

    Files are split like lines of text, at closing braces. A first scan, of files that may be split, tells of every byte range what
    it does to a scan that arrives inside or outside a string; a row for each range comes to the driver, which follows them
    through each file. The second scan then starts in each range in its right state and cuts out the elements; those that go
    over ranges are put together. A range is read in batches, an element must fit a string. Elements are not parsed here; a file
    that is not one array fails the query, empty files have no elements.
    """
    meta = {"file": "_metadata.file_path", "block": "_metadata.file_block_start"}
    text = spark.read.text(path, lineSep=PIECE_END)
    pieces = text.select(*(F.col(c).alias(n) for n, c in meta.items()), F.col("_metadata.file_size").alias("file_size"), (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole"), F.col("value").cast("binary").alias("value"))
    split = pieces.where("not whole")
    ranges = split.select("file", "block", "value").mapInArrow(_ranges, "file string, block long, size long, ends string")
    ranges = ranges.join(split.select("file", "file_size").distinct(), "file")
    begun = _begun(ranges.collect())
    found = pieces.select("file", "block", "value", "whole", "file_size").mapInArrow(_elements(begun), ELEMENTS)
    parts = split.select("file", "block", "value", "whole", "file_size").mapInArrow(_elements(begun), ELEMENTS).where("not whole")
    joined = parts.groupBy("file", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]), "").alias("line"), F.max("closed").alias("closed"))
    blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    joined = joined.where(~(blank & F.col("closed") & (F.col("seq") == 0)))
    return found.where("whole").select("file", "seq", "line").unionByName(joined.select("file", "seq", "line"))
