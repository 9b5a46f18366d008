"""K-d tree sharding of documents by their metadata, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import write_table

BINS = 1024
#: Documents of a shard that get their slots together.
SLOT_ROWS = 50_000
_TOP = 1 << 62


@dataclass
class _Node:
    shards: range
    chain: tuple[str, ...] = ()  # the split dimension, and what tells its ties apart, down to the row
    fixed: tuple[int, ...] = ()  # the median's values in the first columns of chain; low and high are of the next one
    low: int = 0
    high: int = 0
    below: int = 0  # bytes left of low
    target: int = 0
    cut: tuple[int, ...] | None = None  # what comes before these values of chain goes left,
    last_left: bool = False  # and so do rows with these values
    kids: list = field(default_factory=list)

    @property
    def by(self) -> str:
        return self.chain[len(self.fixed)]

    @property
    def then(self) -> str | None:
        return self.chain[len(self.fixed) + 1] if len(self.fixed) + 1 < len(self.chain) else None

    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)


#: What tells rows with the same value apart: the id, the text's checksum, the row's number.
TIES = ("k", "text_crc32", "row")


def _leaves(node: _Node) -> list[_Node]:
    return [x for k in node.kids for x in _leaves(k)] if node.kids else [node]


def _number(node: _Node) -> Column:
    """The first shard of the leaf that a row falls into."""
    if not node.kids:
        return F.lit(node.shards.start)
    left = F.lit(node.last_left)
    for c, v in reversed(list(zip(node.chain, node.cut, strict=False))):
        left = (F.col(c) < v) | ((F.col(c) == v) & left)
    return F.when(left, _number(node.kids[0])).otherwise(_number(node.kids[1]))


def _bin(n: _Node) -> Column:
    """Which of BINS equal parts of [low, high] the coordinate is in."""
    x = F.col(n.by)
    if n.high - n.low < _TOP and abs(n.low) < _TOP:
        return F.expr(f"({n.by} - {n.low}L) div {n.width()}L").cast("int")
    return F.floor((x.cast("decimal(38,0)") - F.lit(str(n.low)).cast("decimal(38,0)")) / F.lit(str(n.width())).cast("decimal(38,0)")).cast("int")


def _split(rows: DataFrame, root: _Node, dims: list[str], spans: dict[str, int]) -> None:
    """One level: every leaf with several shards gets two, at the weighted median of its widest dimension."""
    active = {n.shards.start: n for n in _leaves(root) if len(n.shards) > 1}
    at = rows.withColumn("node", _number(root)).where(F.col("node").isin(list(active)))
    for r in at.groupBy("node").agg(F.sum("size").alias("size"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max))).collect():
        n = active[r["node"]]
        wide = {d: (r[f"max_{d}"] - r[f"min_{d}"]) / max(1, spans[d]) for d in dims}
        dim = max(dims, key=lambda d: wide[d])
        n.chain = (dim, *(c for c in TIES if c != dim))
        n.low, n.high, n.target = r[f"min_{dim}"], r[f"max_{dim}"], r["size"] * (len(n.shards) // 2) // len(n.shards)
    todo: dict[int, _Node | None] = {k: n for k, n in active.items() if n.chain}
    again: dict[int, _Node] = {}
    while todo:
        bins, here = F.lit(None).cast("int"), F.lit(False)
        x = y = F.lit(None).cast("long")
        for k, n in todo.items():
            inside = (F.col("node") == k) & F.col(n.by).between(n.low, n.high)
            for c, v in zip(n.chain, n.fixed, strict=False):
                inside &= F.col(c) == v
            bins, here, x = F.when(inside, _bin(n)).otherwise(bins), here | inside, F.when(inside, F.col(n.by)).otherwise(x)
            y = F.when(inside, F.col(n.then)).otherwise(y) if n.then else y
        found = at.select("node", "size", bins.alias("bin"), x.alias("x"), y.alias("y"), here.alias("here")).where("here")
        per = found.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max))).collect()
        for r in sorted(per, key=lambda r: (r["node"], r["bin"])):
            n = todo.get(r["node"])
            if n is None:
                continue
            if n.below + r["size"] < n.target:
                n.below += r["size"]
                continue
            todo[r["node"]] = None  # the bin with the median: what follows doesn't matter
            n.low, n.high = r["min_x"], r["max_x"]
            if n.low < n.high:
                again[r["node"]] = n
            elif r["n"] > 1 and n.then:
                n.fixed, n.low, n.high = (*n.fixed, n.low), r["min_y"], r["max_y"]
                again[r["node"]] = n
            else:
                n.cut, n.last_left = (*n.fixed, n.low), n.target - n.below > n.below + r["size"] - n.target
        todo, again = again, {}
    for n in active.values():
        half = len(n.shards) // 2
        if n.cut is None:  # no rows: where they would go doesn't matter
            n.chain, n.cut = TIES[:1], (0,)
        n.kids = [_Node(n.shards[:half]), _Node(n.shards[half:])]


def _prefix(col: str) -> Column:
    """The first 7 bytes of a string as a number, in the order of the strings; null before all."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(col).cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))


def kd_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, shard, slot (0.. in each shard) for every row of docs.

    A k-d tree over doc_id, size and the string columns: a node with several shards is split at the weighted median (by size)
    of its widest dimension, relative to the whole table's, until a leaf has one shard; the target of a leaf is its share of all
    bytes. Ties in a dimension are split by doc_id, then by the text's checksum, then by a number of the row, so neither a source
    nor an id with a third of all rows unbalances the shards: each split is within half a document of its target. Medians come from histograms of BINS bins that are refined around the
    target: a pass over the narrow rows each, aggregated before the shuffle; the driver gets at most BINS rows a node.

    Slots are counted in buckets of about SLOT_ROWS rows of a shard, and buckets are put one after another.

    Null texts have 8 bytes; null ids and strings come before others; rows with equal ids may be split; an empty table gives no rows; other columns are ignored; a missing string column is no dimension.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    strings = tuple(s for s in strings if s in docs.columns)
    doc = F.col(id_col).cast("long")
    rows = docs.select(
        doc.alias("doc_id"),
        F.coalesce(doc, F.lit(-(1 << 63)).cast("long")).alias("k"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
        *(_prefix(s).alias(f"d{i}") for i, s in enumerate(strings)),
    )
    rows = write_table(rows, "sizes")
    dims = ["k", "size", *(f"d{i}" for i in range(len(strings)))]
    root = _Node(range(n_shards))
    whole = rows.agg(F.count("*").alias("n"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max))).first()
    if whole["n"]:
        spans = {d: whole[f"max_{d}"] - whole[f"min_{d}"] for d in dims}
        while any(len(n.shards) > 1 for n in _leaves(root)):
            _split(rows, root, dims, spans)
    buckets = whole["n"] // (n_shards * SLOT_ROWS) + 1
    placed = rows.select("doc_id", "size", "text_crc32", _number(root).cast("int").alias("shard"), "row", F.pmod(F.xxhash64("k", "row"), F.lit(buckets)).cast("int").alias("bucket"))
    before = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")
    return placed.withColumn("nth", F.row_number().over(inside)).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
