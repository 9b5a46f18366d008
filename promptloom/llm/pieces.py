"""SentencePiece encoding and decoding; very long documents by a max-plus scan over chunks.

The public model merges pairs (BPE), so the highest sum of piece scores is not what the library returns. Its result is still a
path of a lattice: the one whose neighbouring pieces all survive being encoded together. With weight 0 for such neighbours
and minus infinity for others, that path is the only finite one, and the max-plus scan finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import shuffle_partitions, write_table
from promptloom.llm.keyed import keyed_docs
from promptloom.sources.slices import slices

#: Characters of a chunk; longer texts are cut.
CHUNK = 16_384
#: Pairs of pieces that a worker remembers.
PAIRS = 1 << 16
MARK = "▁"
State = tuple[int, str | None]  # where the next piece starts; the piece before, or None after a place that no piece crosses
Matrix = dict[State, dict[State, float]]


class Pieces:
    """The library and the model's vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.vocab_size())]
        special = [self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i) for i in range(len(names))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(names, special, strict=True)) if not s}
        self.longest = max(map(len, self.ids))
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else b"" if self.lib.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.pair_ok = lru_cache(PAIRS)(self._pair_ok)

    def normal(self, text: str) -> str:
        return self.lib.normalize(text)

    def raw(self, s: str) -> list[int]:
        """Ids of normalized text without the mark that the library puts in front: a line feed, which joins nothing, takes it."""
        return self.lib.encode("\n" + s)[2:] if s else []

    def cut_at(self, s: str, i: int) -> bool:
        """Whether no piece crosses s[i - 1] | s[i]."""
        if i <= 0 or i >= len(s):
            return True
        a, b = s[i - 1], s[i]
        return (b == MARK and a != MARK and not self.crossing) or a not in self.ids or b not in self.ids

    def _pair_ok(self, a: str | None, b: str) -> bool:
        want = [self.ids[x] for x in (a, b) if x is not None]
        return self.raw((a or "") + b) == want

    def walk(self, s: str, start: State, stop: int) -> dict[State, State | None]:
        """States reached from start (each with the one before) by pieces that begin before stop, up to the next place that no
        piece crosses."""
        seen: dict[State, State | None] = {start: None}
        todo = [start]
        while todo:
            todo.sort(key=lambda x: -x[0])
            at, last = todo.pop()
            if at >= stop or (at > start[0] and self.cut_at(s, at)):
                continue
            for end in range(at + 1, min(len(s), at + self.longest) + 1):
                piece = s[at:end]
                if piece in self.ids and self.pair_ok(last, piece) and (end, piece) not in seen:
                    seen[end, piece] = (at, last)
                    todo.append((end, piece))
                if self.cut_at(s, end):
                    break
        return seen

    def next_cut(self, s: str, i: int, stop: int) -> int | None:
        return next((j for j in range(i, stop + 1) if self.cut_at(s, j)), None)

    def last_cut(self, s: str, i: int, least: int) -> int | None:
        return next((j for j in range(i, least - 1, -1) if self.cut_at(s, j)), None)

    def entries(self, s: str, p: int) -> list[State]:
        """States that the text before may leave at p."""
        if self.cut_at(s, p):
            return [(p, None)]
        out: list[State] = []
        for start in range(p - 1, max(-1, p - self.longest - 1), -1):
            for end in range(p, min(len(s), start + self.longest) + 1):
                if s[start:end] in self.ids and not any(self.cut_at(s, j) for j in range(start + 1, end)) and self.pair_ok(None, s[start:end]):
                    out.append((end, None if self.cut_at(s, end) else s[start:end]))
            if self.cut_at(s, start):
                break
        return list(dict.fromkeys(out))

    def exits(self, s: str, q: int, reached: dict[State, State | None]) -> list[State]:
        """Of the states reached: those whose piece begins before q and ends there or later; after a cut, its plain state."""
        return sorted({(e, None) if self.cut_at(s, e) else (e, t) for e, t in reached if e >= q and (t is None or e - len(t) < q)}, key=str)

    def matrix(self, s: str, p: int, q: int) -> Matrix:
        """From the states at p to those at q of s, a chunk with its neighbours' edges."""
        last = self.last_cut(s, q, p)
        tail = None if last is None else ([(q, None)] if last == q else self.exits(s, q, self.walk(s, (last, None), q)))
        out: Matrix = {}
        for e in self.entries(s, p):
            first = self.next_cut(s, e[0], q)
            if first is None:
                goals = self.exits(s, q, self.walk(s, e, q)) if e[0] < q else [e]
            else:
                ends = first == e[0] or any(x[0] == first for x in self.walk(s, e, first))
                goals = tail if ends else []
            if goals:
                out[e] = dict.fromkeys(goals, 0.0)
        return out

    def path(self, s: str, start: State, goal: State, stop: int) -> list[int]:
        """Ids from start to goal, whose piece is any where goal is plain."""
        reached = self.walk(s, start, stop)
        at = next(x for x in reached if x[0] == goal[0] and x != start and goal[1] in (None, x[1])) if goal[0] > start[0] else start
        out: list[int] = []
        while at != start:
            out.append(self.ids[at[1]])
            at = reached[at]
        return out[::-1]

    def between(self, s: str, q: int, start: State, goal: State) -> list[int]:
        """Ids of the pieces that begin at start or later and before q, when goal follows."""
        first = self.next_cut(s, start[0], q)
        if first is None:
            return self.path(s, start, goal, q) if start[0] < q else []
        last = self.last_cut(s, q, first)
        head = self.path(s, start, (first, None), first) if first > start[0] else []
        tail = self.path(s, (last, None), goal, q) if goal[0] > last else []
        return head + self.raw(s[first:last]) + tail


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product; missing entries are minus infinity."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[State, float] = {}
        for k, x in row.items():
            for j, y in b.get(k, {}).items():
                best[j] = max(best.get(j, -np.inf), x + y)
        if best:
            out[i] = best
    return out


def boundary_states(matrices: list[Matrix]) -> list[State]:
    """The state at each boundary of the chunks (one more than chunks) on the best path: products of the halves are combined by
    a tree, and a boundary's state is chosen on the way down."""

    def tree(lo: int, hi: int) -> tuple:
        if hi - lo == 1:
            return matrices[lo], None, None
        left, right = tree(lo, (lo + hi) // 2), tree((lo + hi) // 2, hi)
        return multiply(left[0], right[0]), left, right

    def choose(node: tuple, enter: State, leave: State) -> list[State]:
        _, left, right = node
        if left is None:
            return []
        row = left[0][enter]
        middle = max((k for k in row if leave in right[0].get(k, {})), key=lambda k: row[k] + right[0][k][leave])
        return [*choose(left, enter, middle), middle, *choose(right, middle, leave)]

    root = tree(0, len(matrices))
    (enter, row), *_ = root[0].items()
    leave = max(row, key=row.get)
    return [enter, *choose(root, enter, leave), leave]


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


ENCODED = "key long, doc_id long, part int, ids binary"


def _whole(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = pieces_of(model).lib
        for c in slices(batches, "text"):
            ids = [np.array(x, "<u4").tobytes() for x in lib.encode(c.column("text").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([c.column("key"), c.column("doc_id"), pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["key", "doc_id", "part", "ids"])

    return run


CHUNKS = "key long, doc_id long, part int, base long, p long, q long, text string"


def _cut(model: str, chunk: int):
    """A long text -> its chunks, each with enough of its neighbours for the pieces that cross its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces_of(model)
        for b in slices(batches, "text"):
            for key, doc, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                s = m.normal(text)
                rows = []
                for part, p in enumerate(range(0, len(s), chunk)):
                    q = min(len(s), p + chunk)
                    lo, hi = max(0, p - 2 * m.longest), min(len(s), q + 2 * m.longest)
                    rows.append((key, doc, part, lo, p - lo, q - lo, s[lo:hi]))
                for at in range(0, len(rows), 64):
                    cols = list(zip(*rows[at : at + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "doc_id", "part", "base", "p", "q", "text"])

    return run


ENTRIES = "key long, part int, from_at long, from_piece string, to_at long, to_piece string, score double"


def _matrices(model: str):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces_of(model)
        for b in slices(batches, "text"):
            rows = []
            for key, part, base, p, q, text in zip(*(b.column(c).to_pylist() for c in ("key", "part", "base", "p", "q", "text")), strict=True):
                for (a, x), row in m.matrix(text, p, q).items():
                    rows += [(key, part, base + a, x, base + c, y, score) for (c, y), score in row.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in ENTRIES.split(", ")])

    return run


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """A document's matrices -> the states of each chunk."""
    n = int(pdf["part"].max()) + 1
    matrices: list[Matrix] = [{} for _ in range(n)]
    clean = lambda x: x if isinstance(x, str) else None
    for part, at, piece, to, then, score in zip(*(pdf[c].tolist() for c in ("part", "from_at", "from_piece", "to_at", "to_piece", "score")), strict=True):
        matrices[part].setdefault((at, clean(piece)), {})[to, clean(then)] = score
    s = boundary_states(matrices)
    rows = [(pdf["key"].iloc[0], i, s[i][0], s[i][1], s[i + 1][0], s[i + 1][1]) for i in range(n)]
    return pd.DataFrame(rows, columns=["key", "part", "from_at", "from_piece", "to_at", "to_piece"])


def _backtrace(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces_of(model)
        for b in slices(batches, "text"):
            states = zip(*(b.column(c).to_pylist() for c in ("text", "q", "base", "from_at", "from_piece", "to_at", "to_piece")), strict=True)
            ids = [np.array(m.between(text, q, (at - base, piece), (to - base, then)), "<u4").tobytes() for text, q, base, at, piece, to, then in states]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "part")), pa.array(ids, pa.binary())], ["key", "doc_id", "part", "ids"])

    return run


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, part, ids (little-endian unsigned 32-bit) of every row of docs: the library's ids for the model, without begin
    or end. Texts of at most `chunk` bytes have one part, encoded by the library as it is.

    Longer ones are cut every `chunk` characters and dealt out. Each chunk gives its transfer matrix: from the states in which
    the text before may leave it to those in which it may leave the text behind (a few, as pieces are short; one, where a word
    ends). A document's matrices are multiplied by a tree; with the states known, every chunk gives its ids on its own.

    Null and empty texts have one part without ids; repeated or null ids are told apart by key; an empty table gives no rows;
    other columns are ignored.
    """
    rows = keyed_docs(docs, id_col, text_col)
    long = F.octet_length("text") > chunk
    whole = rows.where(~long).mapInArrow(_whole(model), ENCODED)
    chunks = write_table(rows.where(long).mapInArrow(_cut(model, chunk), CHUNKS).repartition(F.col("key"), F.col("part")), "chunks")
    # a number of partitions, as adaptive execution would put the few bytes of all matrices into one task
    entries = chunks.mapInArrow(_matrices(model), ENTRIES).repartition(shuffle_partitions(docs.sparkSession), "key")
    states = entries.groupBy("key").applyInPandas(_states, ENTRIES.rsplit(", ", 1)[0])
    parts = chunks.join(states, ["key", "part"]).mapInArrow(_backtrace(model), ENCODED)
    return whole.unionByName(parts)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with data: the bytes of each part; a document's parts put together are its text, without the space that the
    library puts in front. A part without ids has no bytes; ids that are no text give their bytes as they are; an empty table
    gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(model).bytes
        for b in slices(batches, "ids"):
            data = []
            for part, raw in zip(b.column("part").to_pylist(), b.column("ids").to_pylist(), strict=True):
                x = b"".join(map(table.__getitem__, np.frombuffer(raw, "<u4").tolist()))
                data.append(x[1:] if part == 0 and x[:1] == b" " else x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "part", "ids")), pa.array(data, pa.binary())], ["key", "doc_id", "part", "ids", "data"])

    return encoded.select("key", "doc_id", "part", "ids").mapInArrow(run, f"{ENCODED}, data binary")
