"""Packing of documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import write_table
from promptloom.llm.tokens import token_ids

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, fill int, closed boolean"
#: Open windows of one task, and how many tasks' leftovers meet in one task of the next round.
OPEN_WINDOWS, FAN_IN = 1024, 8


class Windows:
    """At most `keep` open windows of `size` tokens; free space -> stack of windows, and a bit for each space in use."""

    def __init__(self, size: int, keep: int):
        self.size, self.keep, self.n, self.bits, self.by_free = size, keep, 0, 0, {}

    def _put(self, free: int, window: list) -> None:
        self.by_free.setdefault(free, []).append(window)
        self.bits |= 1 << free
        self.n += 1

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        window = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n -= 1
        return window

    def add(self, piece: tuple, length: int) -> list | None:
        """Best fit, for 0 < length < size. Returns a window that leaves: the one now full, or the fullest when the piece fits
        nowhere and all are in use."""
        fits = self.bits >> length
        out = None
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            window = self._take(free)
        else:
            free, window = self.size, []
            if self.n >= self.keep:
                out = self._take((self.bits & -self.bits).bit_length() - 1)
        window.append(piece)
        if free == length:
            return window
        self._put(free - length, window)
        return out

    def rest(self) -> Iterator[list]:
        for stack in self.by_free.values():
            yield from stack
        self.by_free, self.bits, self.n = {}, 0, 0


def _batches(rows: Iterator[tuple], per: int = 2000) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "fill", "closed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    for r in rows:
        held.append(r)
        if len(held) >= per:
            yield batch()
            held = []
    if held:
        yield batch()


def _packed(pieces: Iterator[tuple], size: int, keep: int, level: int, last: bool) -> Iterator[tuple]:
    """pieces: (doc_id, start, length, doc_tokens, ids). Rows of PIECES; sequence_id: level, task and number of the sequence."""
    windows, base, seq = Windows(size, keep), (level << 57) | (TaskContext.get().partitionId() << 32), 0

    def emit(window: list, closed: bool) -> Iterator[tuple]:
        nonlocal seq
        offset, fill = 0, sum(p[2] for p in window)
        for p in window:
            yield (*p, base | seq, offset, fill, closed)
            offset += p[2]
        seq += 1

    for p in pieces:
        if p[2] >= size:
            yield from emit([p], True)
        elif (out := windows.add(p, p[2])) is not None:
            yield from emit(out, True)
    for w in windows.rest():
        yield from emit(w, last)


def _first(tokenizer: str, end_id: int, size: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, step = token_ids(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * size

        def pieces() -> Iterator[tuple]:
            for b in batches:
                docs = iter(b.column("doc_id").to_pylist())
                for flat, offsets in known.batches(b.column("text").to_pylist()):
                    data, cut = flat.astype("<u4").tobytes(), (4 * offsets).tolist()
                    for x, y in zip(cut[:-1], cut[1:], strict=True):
                        ids, doc = data[x:y] + end, next(docs)
                        for at in range(0, len(ids), step):
                            part = ids[at : at + step]
                            yield doc, at // 4, len(part) // 4, len(ids) // 4, part

        try:
            yield from _batches(_packed(pieces(), size, keep, 0, False))
        finally:
            known.forget()

    return run


def _again(size: int, keep: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")), strict=True)

        yield from _batches(_packed(pieces(), size, keep, level, last))

    return run


def _task() -> Column:
    """The task that packed a sequence."""
    return F.shiftright("sequence_id", 32).bitwiseAND((1 << 25) - 1)


def _dealt(rest: DataFrame, tasks: int) -> DataFrame:
    """The leftovers of a round in `tasks` partitions, those of a task together and FAN_IN tasks at most in each."""
    return rest.repartitionById(tasks, F.pmod(_task(), F.lit(tasks)).cast("int"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, keep: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens: doc_id, start (its ids before the piece), length, doc_tokens,
    ids (little-endian unsigned 32-bit), sequence_id, offset (of the piece in its sequence).

    A document's ids are those of its text and then end_id. Every scan task packs its own documents as they come, with `keep`
    open windows: whole windows of a long document leave at once, what is left of it goes where it fits best, and the fullest
    window leaves when it fits nowhere. The windows still open at the end of a task are merged: their pieces, longest first, are
    packed again by fewer and fewer tasks, each of which gets the leftovers of FAN_IN tasks at most (dealt by the tasks' numbers,
    not by a hash of them), until there is one. So no task or round holds more than a fixed number of windows, and only
    leftovers are shuffled.

    Null texts are empty: a document of end_id alone. Repeated rows and null ids are packed like others; an empty table gives no
    rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    done = write_table(rows.mapInArrow(_first(tokenizer, end_id, size, keep), PIECES), "packed")
    tasks = (done.agg(F.max(_task())).first()[0] or 0) + 1
    out, level = done.where("closed"), 0
    rest = done.where("not closed")
    while True:
        tasks, level = -(-tasks // FAN_IN), level + 1
        ordered = _dealt(rest, tasks).sortWithinPartitions(F.desc("length"), "doc_id", "start")
        part = write_table(ordered.mapInArrow(_again(size, keep, level, tasks <= 1), PIECES), "packed")
        out = out.unionByName(part.where("closed"))
        rest = part.where("not closed")
        if tasks <= 1:
            break
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


