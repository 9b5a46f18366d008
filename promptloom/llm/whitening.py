"""Whitening of embeddings: moments by Welford updates, merged by the parallel formula, and a symmetric QR eigen-solve."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import write_table

#: An entry c stands for the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: States that one task merges into one; entries from which on that number is no long; share of the trace below which an
#: eigenvalue is rounding.
FAN_IN, TOO_LARGE, NOTHING = 64, 2.0**52, 1e-12

STATE = "part long, n long, mean binary, moments binary, sums string"


@dataclass
class Moments:
    """n rows: their mean, the sum of the products of their deviations from it, and the exact sums of whole entries."""

    n: int
    mean: np.ndarray
    moments: np.ndarray
    sums: list[int]

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)), [0] * width)

    def add(self, rows: np.ndarray) -> None:
        """Welford: a rank-one update for each row."""
        product = np.empty_like(self.moments)
        for row in rows:
            self.n += 1
            off = row - self.mean
            self.mean += off / self.n
            np.multiply.outer(off, off * ((self.n - 1) / self.n), out=product)
            self.moments += product

    def merge(self, other: Moments) -> None:
        """Of both: the means' distance adds a rank-one term."""
        if not other.n:
            return
        n, off = self.n + other.n, other.mean - self.mean
        self.moments += other.moments + np.multiply.outer(off, off * (self.n * other.n / n))
        self.mean += off * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self, part: int) -> tuple:
        return part, self.n, self.mean.tobytes(), self.moments.tobytes(), ",".join(map(str, self.sums))

    @classmethod
    def of(cls, n: int, mean: bytes, moments: bytes, sums: str) -> Moments:
        m = np.frombuffer(mean).copy()
        return cls(n, m, np.frombuffer(moments).reshape(len(m), len(m)).copy(), [int(x) for x in sums.split(",")])


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def _sums(x: np.ndarray) -> list[int]:
    """Exact, whatever their size."""
    if len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62:
        return [int(v) for v in x.astype(object).sum(axis=0)]
    return x.sum(axis=0).tolist()


def _states(width: int, project) -> object:
    """A partition -> its Moments. project gives, for whole vectors, the rows that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            x = whole(_vectors(b, width))
            rows = project(x)
            found = found or Moments.none(rows.shape[1])
            found.add(rows)
            if rows.shape[1] == width:
                found.sums = [a + s for a, s in zip(found.sums, _sums(x), strict=True)]
        if found and found.n:
            cols = [[c] for c in found.row(TaskContext.get().partitionId())]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "n", "mean", "moments", "sums"])

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    states = [Moments.of(*r) for r in pdf.sort_values("part")[["n", "mean", "moments", "sums"]].itertuples(index=False)]
    for s in states[1:]:
        states[0].merge(s)
    return pd.DataFrame([states[0].row(int(pdf["part"].min()) // FAN_IN)], columns=["part", "n", "mean", "moments", "sums"])


def gathered(vectors: DataFrame, width: int, project) -> Moments | None:
    """The Moments of all rows: a state for each partition, written, and merged FAN_IN to one until one is left. A state has
    width * width numbers, whatever the rows are; that one comes to the driver."""
    states = write_table(vectors.mapInArrow(_states(width, project), STATE), "moments")
    most = states.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while most > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_merged, STATE)
        most //= FAN_IN
    return Moments.of(*states.select("n", "mean", "moments", "sums").first())


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: reflections make it tridiagonal, and implicit
    QR steps with Wilkinson's shift make what is beside the diagonal vanish. A vector's largest entry is positive."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        head = -np.copysign(size, v[0])
        v[0] -= head
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = head
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    q, end, eps = q.T.copy(), n - 1, np.finfo(float).eps
    while end > 0:
        for i in range(end):
            if abs(e[i]) <= eps * (abs(d[i]) + abs(d[i + 1])):
                e[i] = 0.0
        if e[end - 1] == 0:
            end -= 1
            continue
        start = end - 1
        while start > 0 and e[start - 1] != 0:
            start -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            d0, d1, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * d0 + 2 * c * s * off + s * s * d1, s * s * d0 - 2 * c * s * off + c * c * d1
            e[k] = c * s * (d1 - d0) + (c * c - s * s) * off
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    values = np.array(d)
    order = np.argsort(-values, kind="stable")
    vectors = q[order].T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values[order], vectors * np.where(signs == 0, 1, signs)


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they are enough, else Python's."""
    large = max(int(np.abs(x).max(initial=0)), *(abs(s) // n + 1 for s in sums))
    if 2 * n * large < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(off: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; None where it is no long."""
    if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in off]
    return [s if s < 1 << 63 else None for s in sums]


WHITE = "vec_id long, component int, n long, deviation long, whitened double"


def _whitened(width: int, n: int, sums: list[int], basis: np.ndarray):
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = _from_mean(whole(_vectors(b, width)), n, sums)
            white = (off / n).astype(float) @ basis
            rows = np.repeat(np.arange(len(off)), k)
            far = pa.array(_squares(off), pa.int64())
            cols = [b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))), pa.array(np.full(len(rows), n, np.int64)), far.take(pa.array(rows)), pa.array(white.ravel())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    An entry c counts as the whole number x = floor(1024 c) + 100000. The covariance of x over all vectors (divisor n) comes from
    Welford's updates in every partition, merged by the parallel formula in a tree; its unit eigenvectors, by falling eigenvalue,
    from symmetric_eigen. deviation is the exact sum over dimensions of (n x - S)^2, S the sums; null where it is no long.
    whitened is the projection of x - S / n over the root of the eigenvalue, explained the eigenvalue's share of the trace;
    identity_error the largest entry of whitened's covariance, gathered in the same way in a second pass, minus the identity.

    Vectors that are null, empty, or hold null or non-finite entries take no part; nor do those whose length is not the most
    frequent one (of equally frequent ones the largest), or that hold an entry of 2^52 or more in size, whose x may be no long.
    Components without variance - all, if the vectors are equal - can't be scaled to variance 1 and are left out. Repeated rows and
    ids count each; null ids stay null; other columns are ignored; an empty table gives no rows. No vector is shuffled, and what a
    task or the driver holds of the fit is a matrix of the vector's length squared.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False))))
    length = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("rows")).where("width > 0").orderBy(F.desc("rows"), F.desc("width")).first()
    none = rows.sparkSession.createDataFrame([], f"{WHITE}, explained double, identity_error double")
    if length is None:
        return none
    width = length["width"]
    rows = rows.where(F.size("vector") == width)
    fit = gathered(rows, width, lambda x: x.astype(float))
    values, vectors = symmetric_eigen(fit.moments / fit.n)
    trace = float(np.trace(fit.moments / fit.n))
    k = int((values[:components] > NOTHING * trace).sum()) if trace > 0 else 0
    if not k:
        return none
    basis = vectors[:, :k] / np.sqrt(values[:k])
    n, sums = fit.n, fit.sums
    white = gathered(rows, width, lambda x: (_from_mean(x, n, sums) / n).astype(float) @ basis)
    error = float(np.abs(white.moments / white.n - np.eye(k)).max())
    share = F.element_at(F.array(*(F.lit(float(v / trace)) for v in values[:k])), F.col("component"))
    out = rows.mapInArrow(_whitened(width, n, sums, basis), WHITE)
    return out.withColumns({"explained": share, "identity_error": F.lit(error)})
