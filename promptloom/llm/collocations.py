"""Phrase collocations: contiguous patterns that grow to the right from projected occurrences, prefix by prefix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import write_table
from promptloom.llm.keyed import bucket_bits, from_planes, from_steps, mix, release, runs, segments, to_planes, to_steps

LONGEST, LEAST, TOP, COVERED = 4, 30, 2000, 80
NO_LANG = "und"
#: Words of a chunk, bytes that are split at once, and the share of all contexts (one in so many for each bucket, one in MOST_HOT at
#: least) from which on a prefix is dealt by its extensions.
CHUNK_WORDS, SLICE_BYTES, HOT_PER_BUCKET, MOST_HOT = 1 << 21, 4 << 20, 4, 1 << 16
#: Contexts of a bucket on average, at most (of up to 2^20 buckets), and phrases that a task gives at once.
BUCKET_CONTEXTS, PHRASES_AT_ONCE = 1 << 20, 1 << 15
#: A row of chunks is megabytes: Spark's Parquet looks at the size of a row group after 100 rows only, and reads whole row groups.
ROW_BY_ROW = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers of words, in the order in which they come; 0 is the end of a piece."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of about SLICE_BYTES, cut before white space."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        cut = max(raw.rfind(b" ", at + 1, at + SLICE_BYTES), raw.rfind(b"\n", at + 1, at + SLICE_BYTES))
        if cut < 0:
            ends = [e for e in (raw.find(b" ", at + SLICE_BYTES), raw.find(b"\n", at + SLICE_BYTES)) if e >= 0]
            if not ends:
                break
            cut = min(ends)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


CHUNK = "lang string, n long, words binary, counts binary, first binary, second binary, third binary, fourth binary, times binary"


def _contexts(x: np.ndarray, open_end: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Numbers of words (0 between pieces) -> (occurrences of each number, the different contexts as columns, how often each
    occurs): a context is a word and up to LONGEST - 1 words after it in its piece, one at least. Of an open end the last words are
    followed only; they start the next chunk."""
    padded = np.concatenate([x, np.zeros(LONGEST, x.dtype)])
    cols = [padded[k : k + len(x)] for k in range(LONGEST)]
    for k in range(2, LONGEST):
        cols[k] = np.where(cols[k - 1] == 0, 0, cols[k])
    starts = x > 0
    if open_end:
        starts[len(x) - LONGEST + 1 :] = False
    counts = np.bincount(x[starts], minlength=1)
    more = starts & (cols[1] > 0)
    high, low = (cols[0][more] << 32) | cols[1][more], (cols[2][more] << 32) | cols[3][more]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(high)))
    high, low, mask = high[new], low[new], (1 << 32) - 1
    return counts, [high >> 32, high & mask, low >> 32, low & mask], times


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> chunks of about CHUNK_WORDS words, for each language: its words with their counts, and its contexts."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    open_now: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    size = 0

    def chunk(lang: str, end: bool) -> tuple[pa.RecordBatch, list[bytes]]:
        numbers, parts = open_now.pop(lang)
        x = np.concatenate(parts)
        counts, cols, times = _contexts(x, not end)
        words = list(numbers)
        row = (lang, len(times), b" ".join(words[1:]), to_planes(np.append(counts, np.zeros(len(words) - len(counts), np.int64))[1:].view(np.uint64)), to_steps(cols[0].view(np.uint64)), *(to_planes(c.view(np.uint64)) for c in cols[1:]), to_planes(times.view(np.uint64)))
        kinds = [pa.string(), pa.int64()] + [pa.binary()] * (len(row) - 2)
        carried = [] if end else [words[i] for i in x[len(x) - LONGEST + 1 :].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names), carried

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass").translate(_LOWER)
            carried: list[bytes] = []
            for part in _slices(raw):
                numbers, parts = open_now.setdefault(lang, (_Numbers(), []))
                words = [*carried, *filter(None, part.replace(b"\n", b" \n ").split(b" "))]
                carried = []
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if len(parts[-1]) and sum(map(len, parts)) >= CHUNK_WORDS and len(raw) > SLICE_BYTES:
                    size -= sum(map(len, parts))
                    out, carried = chunk(lang, False)
                    yield out
            if carried:
                numbers, parts = open_now.setdefault(lang, (_Numbers(), []))
                parts.append(np.fromiter(map(numbers.__getitem__, carried), np.int64, len(carried)))
                size += len(carried)
            if lang in open_now:
                open_now[lang][1].append(np.zeros(1, np.int64))
            if size >= CHUNK_WORDS:
                for k in list(open_now):
                    yield chunk(k, True)[0]
                size = 0
    for k in list(open_now):
        yield chunk(k, True)[0]


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch has up to 64 MB."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _names(row: dict) -> np.ndarray:
    """Hashes of a chunk's words (0 for none)."""
    words = row["words"].split(b" ") if row["words"] else []
    names = np.zeros(len(words) + 1, np.uint64)
    names[1:] = np.fromiter(map(_hash, words), np.uint64, len(words))
    return names


def _numbers(row: dict, depth: int = LONGEST) -> list[np.ndarray]:
    """The first `depth` columns of a chunk's contexts, as numbers of words."""
    return [(from_planes if k else from_steps)(row[c]).astype(np.int32) for k, c in enumerate(("first", "second", "third", "fourth")[:depth])]


def _read(row: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a chunk: hashes of its words, contexts as columns of numbers, times."""
    return _names(row), _numbers(row), from_planes(row["times"])


def _prefixes(lang: str, cols: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """For hashed contexts, a hash of lang and the first 1, 2, ... words of each."""
    at = np.full(1, _hash(lang.encode()), np.uint64)
    for c in cols:
        at = mix(at * _SPREAD + c)
        yield at


def _heavy(most: int):
    """A chunk -> its prefixes of up to LONGEST - 1 words that a share of 1 / most of its contexts has, with the number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names = _names(row)
            for p in _prefixes(row["lang"], (names[c] for c in _numbers(row, LONGEST - 1))):
                first = runs(p)  # contexts are sorted, so those of a prefix are neighbours
                size = np.diff(np.append(first, len(p)))
                often = size * most >= len(p)
                yield pa.RecordBatch.from_arrays([pa.array(p[first][often].view(np.int64)), pa.array(size[often])], ["prefix", "n"])

    return run


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


PROJECTED = "bucket int, lang string, names binary, first binary, second binary, third binary, fourth binary, times binary"


def _dealt(bits: int, hot: np.ndarray):
    """A chunk -> its contexts by buckets: by the first word; by two, three or all words where one, two or three are hot."""
    columns = [c.split()[0] for c in PROJECTED.split(", ")]
    kinds = [pa.int32(), pa.string()] + [pa.binary()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names, cols, times = _read(row)
            by, still = np.zeros(len(times), np.uint64), np.ones(len(times), bool)
            for p in _prefixes(row["lang"], (names[c] for c in cols)):
                np.copyto(by, p, where=still)
                still &= _among(p, hot)
                if not still.any():
                    break
            bucket = (by >> np.uint64(64 - bits)).astype(np.int32)
            del by, p
            order = np.argsort(bucket, kind="stable")
            bucket, times = bucket[order], times[order]
            for k in range(LONGEST):
                cols[k] = cols[k][order]
            out = []
            for lo, hi in segments(bucket):
                used, refs = np.unique(np.concatenate([np.zeros(1, np.int32), *(c[lo:hi] for c in cols)]), return_inverse=True)
                refs = refs[1:].reshape(LONGEST, -1).astype(np.uint64)
                out.append((int(bucket[lo]), row["lang"], to_planes(names[used], 8), *(to_planes(r) for r in refs), to_planes(times[lo:hi])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    return run


GROWN = "lang string, w array<long>, a long"


def _grown(hot: np.ndarray, least: int):
    """A bucket -> phrases of 2 to LONGEST words and how often they occur. The occurrences of a prefix, sorted by what follows, are
    one range; an extension's are a part of it. Ranges are followed depth first, as long as they hold `least` occurrences. Those of
    hot prefixes lie in several buckets: they are followed however few are here, and their counts are parts of a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[list[np.ndarray]]] = {}
        for row in _rows(batches):
            names, own = from_planes(row["names"]), parts.setdefault(row["lang"], [[] for _ in range(LONGEST + 1)])
            for k, c in enumerate(("first", "second", "third", "fourth")):
                own[k].append(names[from_planes(row[c]).astype(np.int64)])
            own[LONGEST].append(from_planes(row["times"]).astype(np.int64))
        for lang in list(parts):
            own, cols = parts.pop(lang), []
            while own:
                cols.append(np.concatenate(own.pop(0)))
            order = np.lexsort(cols[LONGEST - 1 :: -1])
            for k in range(LONGEST + 1):
                cols[k] = cols[k][order]
            times = cols.pop()
            del order
            apart = [*(_among(p, hot) for p in _prefixes(lang, cols[: LONGEST - 1])), np.zeros(len(times), bool)]

            def grow(lo: int, hi: int, prefix: list[int]) -> Iterator[tuple[list[int], int]]:
                depth = len(prefix)
                words = cols[depth][lo:hi]
                first = runs(words)
                often = np.add.reduceat(times[lo:hi], first)
                going = np.flatnonzero((words[first] > 0) & ((often >= least) | apart[depth][lo + first]))
                ends = np.append(first[1:], hi - lo)
                for s, e, w, t in zip(first[going].tolist(), ends[going].tolist(), words[first[going]].view(np.int64).tolist(), often[going].tolist(), strict=True):
                    phrase = [*prefix, w]
                    if depth:
                        yield phrase, t
                    if depth + 1 < LONGEST:
                        yield from grow(lo + s, lo + e, phrase)

            for found in batched(grow(0, len(times), []), PHRASES_AT_ONCE):
                phrases, often = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(phrases, pa.list_(pa.int64())), pa.array(often, pa.int64())], ["lang", "w", "a"])

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        words = row["words"].split(b" ") if row["words"] else []
        yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(words), pa.string()), pa.array(_names(row)[1:].view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(from_planes(row["counts"]).astype(np.int64))], ["lang", "hash", "word", "n"])


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words: lang, hash, word, n; phrases: lang, w, a): all words, and the phrases of 2 to LONGEST words (arrays of hashes) that
    occur at least `least` times."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = write_table(texts.mapInArrow(_chunked, CHUNK), "contexts", ROW_BY_ROW)
    words = chunks.select("lang", "words", "counts").mapInArrow(_vocabulary, "lang string, hash long, word string, n long")
    words = write_table(words.groupBy("lang", "hash").agg(F.min("word").alias("word"), F.sum("n").alias("n")), "words")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(bucket_bits(spark), min(20, (total // BUCKET_CONTEXTS).bit_length()))
    most = min(HOT_PER_BUCKET << bits, MOST_HOT)
    heavy = chunks.select("lang", "words", "first", "second", "third").mapInArrow(_heavy(most), "prefix long, n long")
    heavy = write_table(heavy.groupBy("prefix").agg(F.sum("n").alias("n")), "prefixes")
    # no more than `most` for each length of prefix, as their contexts are different ones
    found = heavy.where(F.col("n") * most >= total).select("prefix").toPandas()["prefix"].to_numpy(np.int64)
    hot = np.sort(found.view(np.uint64))
    dealt = chunks.drop("n", "counts").mapInArrow(_dealt(bits, hot), PROJECTED)
    grown = dealt.groupBy("bucket").applyInArrow(_grown(hot, least), GROWN)
    phrases = write_table(grown.groupBy("lang", "w").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")
    release(spark)
    return words, phrases


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to LONGEST words by score.

    A-Z are lower-cased; texts are split at . , ; : ! ? and line ends into pieces, these at spaces and tabs into words. a, l, r are
    the occurrences within pieces, overlaps included, of a phrase and of the two parts of its worst cut (lowest score, then the
    first); n is the number of words of the language; score is floor(2000000 a / (l + r)). Phrases that lie in a longer one with at
    least COVERED % of their occurrences are left out.

    1. Map tasks number the words of a chunk, and count each word and each different context: a word with the words that follow.
       Chunks are written.
    2. Contexts are dealt by their first word, which projects the occurrences of a prefix into one task; those of a prefix with many
       different contexts by two, three or four words, so that a hot word, pair or triple is many tasks' work. Copies have been
       counted together by then.
    3. A task grows its prefixes to the right, depth first, while they are frequent. Counts of hot prefixes are summed.
    4. Cuts, longer phrases and ranks are joins and groups of the frequent phrases. Ties of score and a go by the phrase's bytes.

    Words are told apart by 64 bits of hash within a language. Null texts are empty, null languages 'und'; empty and repeated rows,
    repeated or null ids make no difference (ids are not read); a text of any length is split and counted in parts; other columns
    are ignored; an empty table gives no rows. Arithmetic is in whole numbers of up to 38 digits.
    """
    words, phrases = phrase_counts(docs, least, lang_col, text_col)
    part = words.where(F.col("n") >= least).select("lang", F.array("hash").alias("w"), F.col("n").alias("f")).unionByName(phrases.select("lang", "w", F.col("a").alias("f")))
    size = F.size("w")
    cuts = phrases.select("lang", "w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "w", "a", "k", F.expr("slice(w, 1, k)").alias("head"), F.expr("slice(w, k + 1, size(w) - k)").alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("w").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("w").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "w").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = [F.slice("w", i, k) for k in range(2, LONGEST) for i in range(1, LONGEST)]
    fits = [(F.size("w") > k) & (F.size("w") >= i + k - 1) for k in range(2, LONGEST) for i in range(1, LONGEST)]
    longer = phrases.where(size > 2).select("lang", F.explode(F.array(*(F.when(f, x) for f, x in zip(fits, inside, strict=True)))).alias("w"), "a")
    longer = longer.where("w IS NOT NULL").groupBy("lang", "w").agg(F.max("a").alias("longer"))
    covered = F.expr(f"coalesce(CAST(longer AS DECIMAL(20,0)) * 100 >= CAST(a AS DECIMAL(20,0)) * {COVERED}, false)")
    kept = worst.join(longer, ["lang", "w"], "left").where(~covered).select("lang", "w", "a", "cut.l", "cut.r", "cut.score")
    by_lang = Window.partitionBy("lang")
    # all that tie with the last one stay until their words are known
    kept = write_table(kept.withColumn("rank", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).where(F.col("rank") <= top).drop("rank"), "ranked")
    spelt = kept.select("lang", "w", F.posexplode("w").alias("at", "hash")).join(words.select("lang", "hash", "word"), ["lang", "hash"])
    spelt = spelt.groupBy("lang", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = kept.join(spelt, ["lang", "w"]).join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    rank = F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
