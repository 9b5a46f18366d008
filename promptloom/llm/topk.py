"""Exact inner-product search by columnar branch and bound."""

from __future__ import annotations

import heapq
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates of one cell of the grid, dimensions added at a time, and candidates of one vertical tile.
CELL_QUERIES, CELL_ROWS, STEP, TILE = 1024, 16_384, 16, 4096


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries

    def floor(self, q: int) -> float:
        """A candidate with a lower score can't be among them."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def _best_of_large(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    whole = [[int(x) for x in r] for r in rows]
    for query, q in zip(query_ids.tolist(), queries, strict=True):
        q = [int(x) for x in q]
        scored = ((-max(-(1 << 63), min((1 << 63) - 1, sum(map(operator.mul, q, r)))), i) for i, r in zip(ids.tolist(), whole, strict=True) if i != query)
        yield from ((query, i, -s) for s, i in heapq.nsmallest(k, scored))


def best_in_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of the k best rows of each query, but for the query's own id.

    Rows lie in tiles, dimension by dimension. All queries meet the first STEP dimensions of a tile at once; then each query
    goes on alone, STEP dimensions at a time, with the rows whose partial score plus the product of the remaining norms
    (Cauchy-Schwarz) still reaches its k-th best score, until no dimension is left. Scores are integers and exact in float64;
    where they might not be, they are computed whole, in Python's integers.
    """
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1] >= 1 << 52:
        yield from _best_of_large(query_ids, queries, ids, rows, k)
        return
    best, width = _Best(len(query_ids), k), queries.shape[1]
    cuts = [*range(0, width, STEP), width] if width else [0]

    def rest(m: np.ndarray) -> np.ndarray:
        """Norms of what is left after each cut."""
        return np.stack([np.sqrt((m[:, c:] ** 2).sum(axis=1)) for c in cuts[1:]]) if width else np.zeros((1, len(m)))

    query_rest = rest(queries)
    # long rows first: they raise the floors
    order = np.argsort(-(rows**2).sum(axis=1), kind="stable")
    ids, rows = ids[order], rows[order]
    for at in range(0, len(ids), TILE):
        tile_ids, tile = ids[at : at + TILE], np.ascontiguousarray(rows[at : at + TILE].T)
        tile_rest = rest(tile.T)
        first = queries[:, : cuts[1]] @ tile[: cuts[1]] if width else np.zeros((len(queries), len(tile_ids)))
        for q in range(len(query_ids)):
            floor = best.floor(q)
            alive = np.flatnonzero((first[q] + query_rest[0, q] * tile_rest[0] + 1e-6 >= floor) & (tile_ids != query_ids[q]))
            score = first[q][alive]
            for b in range(1, len(cuts) - 1):
                if not len(alive):
                    break
                score = score + queries[q, cuts[b] : cuts[b + 1]] @ tile[cuts[b] : cuts[b + 1], alive]
                stay = score + query_rest[b, q] * tile_rest[b, alive] + 1e-6 >= floor
                alive, score = alive[stay], score[stay]
            if len(alive):
                best.add(q, tile_ids[alive], np.rint(score).astype(np.int64))
    for q, query in enumerate(query_ids):
        yield from ((int(query), int(i), int(s)) for i, s in zip(best.ids[q], best.scores[q], strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of `vectors` with the highest inner product for each row of `queries`
    (same columns), ties to the smaller id, never the query's own id; all rows, if fewer.

    Components are integers floor(64 * x). Queries and rows are dealt into cells of about CELL_QUERIES x CELL_ROWS, each
    searched by one task; a row goes to every block of queries and a query to every block of rows, as an exact search must
    compare them, but only the k best of a cell leave it. The winners of a query's cells are ranked in the end.

    Components and scores beyond 64 bits are the largest or smallest such integer.

    Vectors that are null or hold null, NaN or infinite components take no part; shorter vectors count as ending in zeros (an
    empty one scores 0); rows with the same id count once, the largest vector of them; null ids take no part; other columns
    are ignored; no queries or no rows give no result.
    """

    def usable(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        whole = F.transform(x, lambda v: F.floor(v.cast("double") * 64).cast("double"))
        return df.where(fine).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(whole).alias("v"))

    rows, asked = usable(vectors), usable(queries)
    n_rows, n_asked = vectors.count(), queries.count()
    row_blocks, query_blocks = n_rows // CELL_ROWS + 1, n_asked // CELL_QUERIES + 1
    r = rows.select(F.lit(False).alias("asks"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"))
    q = asked.select(F.lit(True).alias("asks"), "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["v"].map(len).max())
        a, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        found = list(best_in_cell(a["id"].to_numpy(), _matrix(list(a["v"]), width), c["id"].to_numpy(), _matrix(list(c["v"]), width), k)) if len(a) and len(c) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = q.unionByName(r).groupBy("qb", "rb").applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
