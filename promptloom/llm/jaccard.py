"""N-gram Jaccard join: groups of documents that are linked by similar sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import write_table
from promptloom.llm.keyed import bucket_bits, from_planes, from_steps, in_larger_runs, keyed_docs, mix, release, runs, segments, to_planes, to_steps
from promptloom.llm.trie import Trie

WORDS, SHARE = 5, 80
#: Bytes of hashes that a map task looks at together; documents of a chunk; sets of one star's cell; sets and bytes of one block.
CHUNK_BYTES, CHUNK_DOCS, STAR_SETS, BLOCK_SETS, BLOCK_BYTES = 16 << 20, 2000, 256, 4096, 16 << 20
STARS = 2
#: Counts of a set's tokens by hash that stand for it in blocks; how many are added up for a first look.
CELLS, COARSE = 512, 4

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The ascending distinct 64-bit hashes of the shingles of `words` words; of the whole, when it has fewer. A-Z are
    lower-cased; words are split by ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n, k = max(1, len(h) - words + 1), min(words, len(h))
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(k):
        out += mix(h[i : i + n] * _FACTORS[i % 5] + np.uint64(i))
    return np.unique(mix(out))


MAPPED = "bucket int, kind int, key long, doc_id long, n long, digest binary, blob binary, docs binary"
DOC, ENTRY, KNOWN, SEEN = range(4)


def _bucketed(bits: int):
    """Texts -> a DOC row each, and for every bucket of a chunk of texts the shingles in it: ENTRY (shingle, document) for
    those of one document of the chunk, SEEN (shingle) for those of several, whose documents are KNOWN to share them."""
    low, buckets = np.uint64(64 - bits), 1 << bits

    def blobs(keys: list[np.ndarray], docs: list[int]) -> Iterator[tuple]:
        key = np.concatenate(keys)
        doc = np.repeat(np.array(docs, np.int64), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        many = in_larger_runs(key)
        for kind, k, d, bucket in (
            (ENTRY, key[~many], doc[~many], (key[~many] >> low).astype(np.int64)),
            (SEEN, key[many][runs(key[many])], None, (key[many][runs(key[many])] >> low).astype(np.int64)),
            (KNOWN, key[many], doc[many], (mix(doc[many].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)),
        ):
            if kind == KNOWN:
                order = np.argsort(bucket, kind="stable")
                k, d, bucket = k[order], d[order], bucket[order]
            for a, b in segments(bucket):
                part = k[a:b] - (np.uint64(bucket[a]) << low) if kind != KNOWN else k[a:b]
                yield int(bucket[a]), kind, None, None, None, None, to_steps(part), to_planes(d[a:b].view(np.uint64)) if d is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, rows, size = [], [], [], 0
        for b in batches:
            for key, doc, text in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                s = shingle_set(text.as_py())
                bucket = int(mix(np.array([key], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                rows.append((bucket, DOC, key, doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), None, None))
                keys.append(s)
                ids.append(key)
                size += 8 * len(s)
                if size >= CHUNK_BYTES:
                    yield _mapped([*rows, *blobs(keys, ids)])
                    keys, ids, rows, size = [], [], [], 0
        if rows:
            yield _mapped([*rows, *blobs(keys, ids)])

    return run


def _mapped(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bucket", "kind", "key", "doc_id", "n", "digest", "blob", "docs"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names)


SHARED = "chunk int, key long, doc_id long, n long, digest binary, blob binary, docs binary"


def _shared(bits: int, chunks: int):
    """A bucket -> its shingles that several documents have, dealt by the chunks of the documents; DOC rows go on."""

    columns = ["chunk", "key", "doc_id", "n", "digest", "blob", "docs"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, bucket = [], int(pdf["bucket"].iloc[0])
        chunk_of = lambda d: (mix(d.view(np.uint64)) >> np.uint64(20)) % np.uint64(chunks)
        docs = pdf[pdf["kind"] == DOC]
        if len(docs):
            chunk = chunk_of(docs["key"].to_numpy(np.int64)).astype(np.int64)
            out += zip(chunk.tolist(), docs["key"], docs["doc_id"], docs["n"], docs["digest"], docs["blob"], docs["docs"], strict=True)
        top = np.uint64(bucket << (64 - bits))
        entry, seen, known = (pdf[pdf["kind"] == k] for k in (ENTRY, SEEN, KNOWN))
        keys = [*map(from_steps, entry["blob"]), *map(from_steps, seen["blob"])]
        doc = [from_planes(d) for d in entry["docs"]]
        kept_keys, kept_docs = list(map(from_steps, known["blob"])), [from_planes(d) for d in known["docs"]]
        if keys:
            key = np.concatenate(keys)
            n_entries = sum(map(len, doc))
            order = np.argsort(key, kind="stable")
            shared = np.zeros(len(key), bool)
            sorted_keys = key[order]
            shared[order] = in_larger_runs(sorted_keys)
            mask = shared[:n_entries]
            if n_entries:
                kept_keys.append(key[:n_entries][mask] | top)
                kept_docs.append(np.concatenate(doc)[mask])
        if kept_keys:
            key, doc = np.concatenate(kept_keys), np.concatenate(kept_docs)
            chunk = chunk_of(doc).astype(np.int64)
            order = np.lexsort((key, chunk))
            key, doc, chunk = key[order], doc[order], chunk[order]
            out += [(int(chunk[a]), None, None, None, None, to_steps(key[a:b]), to_planes(doc[a:b])) for a, b in segments(chunk)]
        return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="Int64" if c in ("key", "doc_id", "n") else None) for i, c in enumerate(columns)})

    return run


SETS = "key long, doc_id long, n long, digest binary, tokens binary"


def _sets(share: int):
    """A chunk -> its documents, with the shingles that others have where these are enough for any link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, entries = pdf[pdf["key"].notna()], pdf[pdf["key"].isna()]
        tokens: dict[int, bytes] = {}
        if len(entries):
            key, doc = np.concatenate(list(map(from_steps, entries["blob"]))), np.concatenate(list(map(from_planes, entries["docs"]))).view(np.int64)
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            sizes = dict(zip(docs["key"].astype("int64"), docs["n"].astype("int64"), strict=True))
            for a, b in segments(doc):
                if 100 * (b - a) >= share * sizes[int(doc[a])]:
                    tokens[int(doc[a])] = to_steps(key[a:b])
        return docs[["key", "doc_id", "n", "digest"]].assign(tokens=[tokens.get(int(k)) for k in docs["key"]])

    return run


def _prefixes(share: int):
    """A set -> the shared shingles of its prefix: in the order that puts unshared ones first, similar sets meet in one of the
    first n - ceil(share n) + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, sets, sizes = [], [], []
            for name, n, raw in zip(*(b.column(c).to_pylist() for c in ("set", "n", "tokens")), strict=True):
                t = from_steps(raw)
                p = t[: max(0, n - -(-share * n // 100) + 1 - (n - len(t)))]
                tokens.append(p)
                sets += [name] * len(p)
                sizes += [n] * len(p)
            t = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64())], ["token", "set", "n"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set -> how many of its tokens fall into each of CELLS parts. The sum of the smaller counts bounds an intersection."""
    for b in batches:
        counts = [to_planes(np.bincount((from_steps(t) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)) for t in b.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("set"), pa.array(counts, pa.binary())], ["set", "sketch"])


def _open(share: int):
    """A cell of one block (side 2) or two (sides 0 and 1) -> its sets whose size and sketch allow a link with a set of another
    component in it, in smaller cells: sets go together that such possible links connect. A row a set, however many links these
    are. A cell is named by its sets, so that one that arises from many tokens is compared once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        name, comp, n = (pdf[c].to_numpy(np.int64) for c in ("set", "comp", "n"))
        fine = np.stack([from_planes(v).astype(np.uint16) for v in pdf["sketch"]])
        coarse = fine.reshape(len(fine), -1, COARSE).sum(axis=2, dtype=np.uint16)
        side = pdf["side"].to_numpy()
        right = np.flatnonzero(side != 0)
        sizes, group = n[right], np.arange(len(pdf))
        for i in np.flatnonzero(side != 1).tolist():
            lo, hi = np.searchsorted(sizes, -(-share * n[i] // 100)), np.searchsorted(sizes, n[i] * 100 // share, side="right")
            near = right[lo:hi]
            near = near[(comp[near] != comp[i]) & ((side[i] != 2) | (near > i))]
            for sketch in (coarse, fine):
                if len(near):
                    bound = np.minimum(sketch[near], sketch[i]).sum(axis=1, dtype=np.int64)
                    near = near[(100 + share) * bound >= share * (n[i] + n[near])]
            if (group[near] != group[i]).any():
                met = np.unique(np.append(group[near], group[i]))
                group[np.isin(group, met)] = met[0]
        order = np.lexsort((side, name, group))
        out = []
        for a, b in segments(group[order]):
            if b - a > 1:
                sets, sides = name[order[a:b]], side[order[a:b]].astype(np.int64)
                cell = xxhash.xxh3_64_intdigest(sets.tobytes() + sides.tobytes()) >> 1
                out.append(pd.DataFrame({"cell": cell, "set": sets, "side": sides}))
        return pd.concat(out) if out else pd.DataFrame({"cell": [], "set": [], "side": []}).astype("int64")

    return run


class _Groups:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _links(share: int):
    """A cell -> a link for every two components of it that similar sets connect. Sets of side 1 are in the tree; those of side
    0 search it; where a cell has one side (2), every set searches those before it. Tokens are ordered by how many of the cell's
    sets have them, so that sets share the beginnings of their paths; what a search has joined to its set's component, it leaves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups, out = _Groups(), []
        trie = Trie(share, groups.find)
        name, comp, n, side = (pdf[c].astype("int64").tolist() for c in ("set", "comp", "n", "side"))
        tokens = list(map(from_steps, pdf["tokens"]))
        every = np.concatenate(tokens)
        known, at, often = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -often))] = np.arange(len(known))
        ends = np.cumsum([0, *map(len, tokens)])
        of = dict(zip(name, comp, strict=True))
        apart = len(set(comp)) - 1
        for i in sorted(range(len(name)), key=lambda i: (-side[i], n[i], name[i])):
            if len(out) == apart:
                break
            t = np.sort(rank[at[ends[i] : ends[i + 1]]])
            if side[i] != 1:
                for other, _ in trie.similar(t, n[i], comp[i]):
                    if groups.join(of[other], comp[i]):
                        out.append((comp[i], of[other]))
            if side[i] != 0:
                trie.add(name[i], t, n[i], comp[i])
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (set, comp) with comp replaced by the smallest that links (a, b: two comps each) reach from it.

    In a round, every component takes the smallest label that it, its label, the labels of its neighbours' labels or the
    neighbours of those with its label have, all of the round before. So distances to the smallest halve at least, and a
    chain takes a logarithm of its length. Only linked components take part; every round is written.
    """
    edges = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    edges = write_table(edges.where("x <> y").distinct(), "links")
    if edges.isEmpty():
        return nodes
    now = write_table(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("f")), "labels")
    # labels are done when no edge has two: the smallest component always has its own
    while not edges.join(now, "x").join(now.select(F.col("x").alias("y"), F.col("f").alias("g")), "y").where("f <> g").isEmpty():
        over = now.join(now.select(F.col("x").alias("f"), F.col("f").alias("ff")), "f")
        near = edges.join(over.select(F.col("x").alias("y"), "ff"), "y").groupBy("x").agg(F.min("ff").alias("near"))
        seen = over.join(near, "x")
        told = seen.groupBy("f").agg(F.min("near").alias("told")).withColumnRenamed("f", "x")
        now = write_table(seen.join(told, "x", "left").select("x", F.least("ff", "near", "told").alias("f")), "labels")
    return write_table(nodes.join(now.withColumnRenamed("x", "comp"), "comp", "left").select("set", F.coalesce("f", "comp").alias("comp")), "labels")


def jaccard_groups(docs: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. Documents are linked when their sets of shingles have
    100 * |intersection| >= share * |union|; component_id is the smallest doc_id that links reach.

    1. Texts are hashed in place; shingles go to hash buckets as packed (hash, document) entries, those that recur inside a map
       task once for all its documents. What no other document has is dropped; the rest goes back to the document's chunk,
       where documents stay that share at least `share` % of their shingles. (Copies stay; others need not look further.)
    2. Documents with equal sets become one set. Sets are ordered by hash; similar ones share a token of their prefixes.
    3. Stars: every set is compared with the smallest set of its token groups, in cells of bounded size, by a prefix tree of
       ordered sets. Linked sets are merged. Token groups of one component are done.
    4. What remains - groups with several components - is compared wholly, in blocks: sets of two blocks whose counts of tokens,
       which bound every intersection, allow no link in them leave; the others are joined by a prefix tree of a block.

    No list of a group's pairs is made: cells give a row for a set that is still open, and a link for components that they join.
    A task holds two blocks (BLOCK_SETS sets, about BLOCK_BYTES) or a bucket at most. A group of g sets that stay in several
    components is g * g / BLOCK_SETS rows of sketches, as every two of its sets must be told apart.

    Null and empty texts have empty sets (n_shingles 0), linked with nothing; a text of fewer than 5 words is one shingle.
    Repeated or null ids are told apart by row; a component's smallest id ignores nulls (null, if it has no other); other
    columns are ignored; an empty table gives no rows. Shingles are told apart by 64 bits of hash, sets by 128, whatever the
    number of partitions.
    """
    spark = docs.sparkSession
    rows, bits = keyed_docs(docs, id_col, text_col), bucket_bits(spark)
    chunks = rows.count() // CHUNK_DOCS + 1
    mapped = rows.mapInArrow(_bucketed(bits), MAPPED)
    found = mapped.groupBy("bucket").applyInPandas(_shared(bits, chunks), SHARED)
    sets = write_table(found.groupBy("chunk").applyInPandas(_sets(share), SETS), "sets")
    release(spark)

    alike = sets.where("tokens is not null and n > 0").groupBy("digest").agg(F.min("key").alias("set"), F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens"))
    alike = write_table(alike.select("set", "n", "tokens", "digest"), "distinct-sets")
    posts = write_table(alike.select("set", "n", "tokens").mapInArrow(_prefixes(share), "token long, set long, n long"), "prefixes")
    labels = alike.select("set", F.col("set").alias("comp"))
    tried = None
    for _ in range(STARS):
        open_posts = write_table(_unsettled(posts, labels), "open")
        first = open_posts.groupBy("token").agg(F.min(F.struct("set", "n", "comp")).alias("hub"))
        pairs = open_posts.join(first, "token").where((F.col("comp") != F.col("hub.comp")) & (100 * F.least("n", "hub.n") >= share * F.greatest("n", "hub.n")))
        pairs = pairs.select("set", F.col("hub.set").alias("hub")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["set", "hub"], "left_anti")
        pairs = write_table(pairs.groupBy("set").agg(F.min("hub").alias("hub")), "stars")
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = components(labels, _compare(_stars(pairs), alike, labels, share))
        posts = open_posts.select("token", "set", "n")
    rest = write_table(_unsettled(posts, labels), "open")
    if not rest.isEmpty():
        sketches = alike.select("set", "tokens").mapInArrow(_sketches, "set long, sketch binary")
        cells = _blocks(rest).join(alike.select("set", "n"), "set").join(labels, "set").join(sketches, "set")
        cells = write_table(cells.groupBy("cell").applyInPandas(_open(share), "cell long, set long, side int").distinct(), "cells")
        labels = components(labels, _compare(cells, alike, labels, share))

    named = labels.join(alike.select("set", "digest"), "set").select("digest", "comp")
    named = sets.where("tokens is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("low")).join(named, "digest")
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(least, "comp").select("digest", F.col("component_id").alias("found"))
    linked = F.col("tokens").isNotNull() & (F.col("n") > 0)
    out = sets.select("doc_id", "n", F.when(linked, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def _unsettled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts with comp, of the tokens whose sets are in several components."""
    now = posts.select("token", "set", "n").join(labels, "set")
    several = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    return now.join(several, "token", "left_semi")


def _stars(pairs: DataFrame) -> DataFrame:
    """cell, set, side: the sets of a hub in cells of about STAR_SETS, each with the hub."""
    size = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    cells = pairs.join(size, "hub").select("hub", "set", F.xxhash64("hub", F.pmod(F.xxhash64("set"), F.floor(F.col("n") / STAR_SETS) + 1)).alias("cell"))
    hubs = cells.select("cell", F.col("hub").alias("set"), F.lit(0).alias("side")).distinct()
    return cells.select("cell", "set", F.lit(1).alias("side")).unionByName(hubs)


def _blocks(posts: DataFrame) -> DataFrame:
    """cell, set, side: every two blocks of about BLOCK_SETS sets of a token's group; groups of the same sets once."""
    group = posts.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.sum(F.xxhash64("set").bitwiseAND((1 << 40) - 1)).alias("sum"), F.bit_xor(F.xxhash64("set")).alias("xor"))
    blocks = F.greatest(F.floor(F.col("size") / BLOCK_SETS), F.floor(8 * F.col("tokens") / BLOCK_BYTES)) + 1
    group = group.groupBy("size", "tokens", "sum", "xor").agg(F.min("token").alias("token")).select("token", blocks.alias("blocks"))
    own = posts.join(group, "token").select("token", "set", "blocks", F.pmod(F.xxhash64("set"), F.col("blocks")).alias("own"))
    pair = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return pair.select(F.xxhash64("token", low, high).alias("cell"), "set", side.alias("side"))


def _compare(cells: DataFrame, alike: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    full = cells.join(alike.select("set", "n", "tokens"), "set").join(labels, "set").select("cell", "set", "side", "n", "comp", "tokens")
    return full.groupBy("cell").applyInPandas(_links(share), "a long, b long")


