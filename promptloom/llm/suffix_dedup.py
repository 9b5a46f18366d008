"""Removal of repeated passages: bytes that a long string covers which occurs earlier, too."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.bwt import window_classes
from promptloom.llm.common import write_table
from promptloom.llm.keyed import bucket_bits, from_planes, in_larger_runs, keyed_docs, mix, release, runs, segments, to_planes

LENGTH = 100
#: Bytes of the strings whose hashes choose anchors; bits of a hash kept besides its bucket; anchors that a map task looks at
#: together; documents and bytes of a chunk; bytes of text in one transform.
GRAM, KEY_BITS, CHUNK_ANCHORS, CHUNK_DOCS, CHUNK_BYTES, BLOCK_BYTES = 32, 40, 1 << 20, 1000, 4 << 20, 1 << 20
#: Places from which on an anchor is hot (but no more than HOT_KEYS anchors of the input are), how many times as many make it very
#: hot, and the offsets of an anchor in a string that stay together then.
HOT_PLACES, HOT_KEYS, VERY, HOT_OFFSETS, VERY_OFFSETS = 1024, 1 << 20, 16, 18, 1

#: Strings of a block of a text, and anchors of it with equal neighbours at one distance from which on it is taken for periodic.
BLOCK_STARTS, PERIODIC = 1 << 20, 64

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    x = mix(np.ascontiguousarray(eight).view("<u8").reshape(-1) + _C[0])
    out = np.zeros(n, np.uint64)
    for i in range(4):
        out += x[8 * i : 8 * i + n] * _C[i]
    return mix(out)


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) of `width` values from each position on."""
    have = 1
    while 2 * have <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the grams, positions of anchors, the least hash in each string of `length` bytes). An anchor is a position
    whose hash is least among the grams of some such string, so equal strings have their anchors at equal offsets."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = _grams(data), length - GRAM + 1
    least = _sliding(np.minimum, h, width)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return h, np.flatnonzero(_sliding(np.maximum, padded, width) == h), least


def owned(h: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string (start) that each anchor owns: the strings whose first least gram it is; first > last for none."""
    starts = np.arange(len(least))
    owner = np.searchsorted(at, starts)
    while True:
        wrong = h[at[owner]] != least
        if not wrong.any():
            break
        owner[wrong] += 1
    first = np.searchsorted(owner, np.arange(len(at)))
    return first, np.searchsorted(owner, np.arange(len(at)), side="right") - 1


def _repeats(data: np.ndarray, from_: int, count: int, periods: list[int], length: int) -> np.ndarray:
    """Of the `count` strings from from_ on, which are equal to the one that starts a period earlier, for any of periods."""
    out = np.zeros(count, bool)
    for p in periods:
        lo = max(from_, p)
        if lo >= from_ + count:
            continue
        same = data[lo : from_ + count + length - 1] == data[lo - p : from_ + count + length - 1 - p]
        differ = np.concatenate([[0], np.cumsum(~same, dtype=np.int64)])
        out[lo - from_ :] |= differ[length:] == differ[: len(differ) - length]
    return out


def strings(data: np.ndarray, length: int = LENGTH, owners: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes and positions of anchors, first and last string that each owns, starts and ends of spans) of a text of any length, in
    blocks of BLOCK_STARTS. Without owners, first and last are left out (empty).

    Where a text is periodic, anchors have equal neighbours at the distance of the period. There, strings that are equal to the one a
    period before are spans at once, as they start earlier in the same text, and only the others have anchors; so a run of any
    length has a period's anchors."""
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    starts, ends = [none], [none]
    for lo in range(0, len(data) - length + 1, BLOCK_STARTS):
        count = min(BLOCK_STARTS, len(data) - length + 1 - lo)
        h, at, least = anchors(data[lo : lo + count + length - 1], length)
        gaps = np.diff(at)[h[at[1:]] == h[at[:-1]]]
        often = np.bincount(gaps, minlength=1)
        periods = np.flatnonzero(often >= PERIODIC).tolist()
        if periods:
            again = _repeats(data, lo, count, periods, length)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
            starts.append(edge[::2] + lo)
            ends.append(edge[1::2] - 1 + length + lo)
            fresh = np.flatnonzero(~again)
            first, last = owned(h, at, least)
            low, high = np.searchsorted(fresh, first), np.searchsorted(fresh, last, side="right")
            keep = (first <= last) & (low < high)
            at, first, last = at[keep], fresh[low[keep]], fresh[high[keep] - 1]
        elif owners:
            first, last = owned(h, at, least)
            keep = first <= last
            at, first, last = at[keep], first[keep], last[keep]
        else:
            first = last = at
        found.append((h[at], at + lo, first + lo, last + lo))
    if not found:
        return np.zeros(0, np.uint64), none, none, none, none, none
    h, at, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")  # an anchor may own strings of two blocks
    h, at, first, last = h[order], at[order], first[order], last[order]
    once = runs(at)
    first, last = (np.minimum.reduceat(first, once), np.maximum.reduceat(last, once)) if owners and len(once) else (none, none)
    _, starts_, ends_ = joined_spans(np.zeros(sum(map(len, starts)), np.int64), np.concatenate(starts), np.concatenate(ends))
    return h[once], at[once], first, last, starts_, ends_


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


ENTRIES = "bucket int, kind int, blob binary, docs binary, at binary"
ENTRY, KNOWN, SEEN, SPAN = range(4)


def _anchor_entries(bits: int, length: int):
    """Texts -> for every bucket the anchors in it: ENTRY (hash, document, position) for hashes seen once in a part of the task,
    SEEN (hash, how often) for others, whose places are KNOWN to recur. Spans that a text alone tells are SPANs (ends, document,
    starts)."""
    shift, buckets = np.uint64(64 - bits - KEY_BITS), 1 << bits

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "blob", "docs", "at"])

    def blobs(keys: list, docs: list, places: list) -> list[tuple]:
        key = np.concatenate(keys) >> shift
        doc = np.repeat(np.array(docs, np.int64), [len(k) for k in keys]).view(np.uint64)
        at = np.concatenate(places).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, doc, at = key[order], doc[order], at[order]
        many = in_larger_runs(key)
        first = runs(key[many])
        seen, often = key[many][first], np.diff(np.append(first, many.sum())).astype(np.uint64)
        spread = (mix(doc[many]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(spread, kind="stable")
        out = []
        for kind, bucket, k, d, p in (
            (ENTRY, (key[~many] >> np.uint64(KEY_BITS)).astype(np.int64), key[~many], doc[~many], at[~many]),
            (SEEN, (seen >> np.uint64(KEY_BITS)).astype(np.int64), seen, None, often),
            (KNOWN, spread[by], None, doc[many][by], at[many][by]),
        ):
            for a, b in segments(bucket):
                own = to_planes(k[a:b] & np.uint64((1 << KEY_BITS) - 1)) if k is not None else None
                out.append((int(bucket[a]), kind, own, to_planes(d[a:b]) if d is not None else None, to_planes(p[a:b]) if p is not None else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, size = [], [], [], 0
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                h, at, _, _, starts, ends = strings(_bytes(text.as_py()), length, owners=False)
                if len(starts):
                    name = np.array([key], np.int64).view(np.uint64)
                    bucket = int(mix(name)[0] % np.uint64(buckets))
                    yield packed([(bucket, SPAN, to_planes(ends.view(np.uint64)), to_planes(np.repeat(name, len(starts))), to_planes(starts.view(np.uint64)))])
                if len(at):
                    keys.append(mix(h))  # least hashes are small; mixed, they spread over all buckets
                    docs.append(key)
                    places.append(at)
                    size += len(at)
                if size >= CHUNK_ANCHORS:
                    yield packed(blobs(keys, docs, places))
                    keys, docs, places, size = [], [], [], 0
        if keys:
            yield packed(blobs(keys, docs, places))

    return run


def _chunk(doc: np.ndarray, chunks: int) -> np.ndarray:
    return ((mix(doc.view(np.uint64)) >> np.uint64(20)) % np.uint64(chunks)).astype(np.int64)


PLACES = "chunk int, docs binary, at binary, ends binary"


def _by_chunk(doc: np.ndarray, at: np.ndarray, ends: np.ndarray | None, chunks: int) -> list[tuple]:
    chunk = _chunk(doc, chunks)
    order = np.argsort(chunk, kind="stable")
    doc, at, chunk = doc[order], at[order], chunk[order]
    return [(int(chunk[a]), to_planes(doc[a:b]), to_planes(at[a:b]), to_planes(ends[order][a:b]) if ends is not None else None) for a, b in segments(chunk)]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})


def _recurring(chunks: int, hot: int):
    """A bucket -> the places of anchors whose hash occurs more than once, dealt by the chunks of their documents, and SPANs as they
    are (with ends); and in chunk -1 the hashes that have `hot` places or more, with their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, seen, known, span = (pdf[pdf["kind"] == k] for k in (ENTRY, SEEN, KNOWN, SPAN))
        docs, at, rows = [from_planes(d) for d in known["docs"]], [from_planes(p) for p in known["at"]], []
        if len(span):
            rows += _by_chunk(_joined(span["docs"]), _joined(span["at"]), _joined(span["blob"]), chunks)
        if len(entry) or len(seen):
            own = _joined(entry["blob"])
            key = np.concatenate([own, *map(from_planes, seen["blob"])])
            times = np.concatenate([np.ones(len(own), np.uint64), *map(from_planes, seen["at"])])
            order = np.argsort(key, kind="stable")
            key = key[order]
            more = np.zeros(len(key), bool)
            more[order] = in_larger_runs(key)
            docs.append(_joined(entry["docs"])[more[: len(own)]])
            at.append(_joined(entry["at"])[more[: len(own)]])
            first = runs(key)
            total = np.add.reduceat(times[order], first)
            if (often := total >= hot).any():
                top = np.uint64(int(pdf["bucket"].iloc[0]) << KEY_BITS)
                rows.append((-1, to_planes(key[first][often] | top), to_planes(total[often]), None))
        rows += _by_chunk(np.concatenate(docs), np.concatenate(at), None, chunks) if docs else []
        return _frame(rows, ["chunk", "docs", "at", "ends"])

    return run


def _joined(planes: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *map(from_planes, planes)])


SLICES = "bucket int, keys binary, docs binary, at binary, skips binary, sizes binary, data binary, ends binary"


def _slices(bits: int, chunks: int, length: int, hot: dict[int, int]):
    """A chunk: its texts and the places of recurring anchors -> for every bucket of anchors the stretches of text that hold
    the strings they own. Equal stretches of a chunk go once, at their first place; the strings of the others recur: spans,
    which go on in the bucket of the chunk.

    hot: anchor -> how many of its offsets in a string stay together. Strings that are equal have their anchor at the same offset,
    and all strings with an anchor at offsets a to b share the bytes between the last start and the first end: their core. So a
    stretch of a hot anchor is cut by offsets, and each part goes by its core, too: an anchor in very many surroundings is
    spread over buckets and transforms, with no string lost."""
    shift = np.uint64(64 - bits - KEY_BITS)

    def run(texts: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if not len(places) or not len(texts):
            return _frame([], ["bucket", "keys", "docs", "at", "skips", "sizes", "data", "ends"])
        told, places = places[places["ends"].notna()], places[places["ends"].isna()]
        doc, at = _joined(places["docs"]).view(np.int64), _joined(places["at"]).astype(np.int64)
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        text = dict(zip(texts["key"].astype("int64"), texts["text"], strict=True))
        known: set[bytes] = set()
        keys, docs, firsts, skips, data = array("Q"), array("q"), array("q"), array("q"), []
        span_docs, span_starts, span_ends = array("q"), array("q"), array("q")

        def new(key: int, name: int, lo: int, skip: int, part: bytes) -> bool:
            mark = xxhash.xxh3_128_digest(part + skip.to_bytes(8, "little"), key)
            if mark in known:
                span_docs.append(name)
                span_starts.append(lo)
                span_ends.append(lo + len(part))
                return False
            known.add(mark)
            return True

        def keep(key: int, name: int, lo: int, skip: int, part: bytes) -> None:
            keys.append(key)
            docs.append(name)
            firsts.append(lo)
            skips.append(skip)
            data.append(part)

        for a, b in segments(doc):
            name = int(doc[a])
            raw = text[name].encode("utf-8", "surrogatepass")
            h, all_at, first, last, _, _ = strings(np.frombuffer(raw, np.uint8), length)
            which = np.searchsorted(all_at, at[a:b])
            which = which[(which < len(all_at)) & (all_at[np.minimum(which, len(all_at) - 1)] == at[a:b])]  # some own no string
            mixed = mix(h[which])
            for i, k, short in zip(which.tolist(), mixed.tolist(), (mixed >> shift).tolist(), strict=True):
                lo, hi, p = int(first[i]), int(last[i]), int(all_at[i])
                part = raw[lo : hi + length]
                if not new(k, name, lo, p - lo, part):
                    continue
                together = hot.get(short)
                if together is None:
                    keep(k, name, lo, p - lo, part)
                    continue
                for a0 in range((p - hi) // together * together, p - lo + 1, together):
                    a1 = a0 + together - 1
                    core = xxhash.xxh3_64_intdigest(raw[p - a0 : p - a1 + length], (k + a0) % (1 << 64))
                    start = max(lo, p - a1)
                    cut = raw[start : min(hi, p - a0) + length]
                    if new(core, name, start, p - start, cut):
                        keep(core, name, start, p - start, cut)
        out = []
        if keys:
            key = np.array(keys, np.uint64)
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            d, f, s = np.array(docs, np.int64)[by].view(np.uint64), np.array(firsts, np.uint64)[by], np.array(skips, np.uint64)[by]
            size = np.array([len(x) for x in data], np.uint64)[by]
            key, bucket, data = key[by], bucket[by], [data[i] for i in by]
            for a, b in segments(bucket):
                out.append((int(bucket[a]), to_planes(key[a:b], 8), to_planes(d[a:b]), to_planes(f[a:b]), to_planes(s[a:b]), to_planes(size[a:b]), b"".join(data[a:b]), None))
        if len(told):
            span_docs.extend(_joined(told["docs"]).view(np.int64).tolist())
            span_starts.extend(_joined(told["at"]).tolist())
            span_ends.extend(_joined(told["ends"]).tolist())
        if span_docs:
            where = int(mix(np.array([texts["chunk"].iloc[0]], np.uint64))[0] % np.uint64(1 << bits))
            out.append((where, None, to_planes(np.array(span_docs, np.int64).view(np.uint64)), to_planes(np.array(span_starts, np.uint64)), None, None, None, to_planes(np.array(span_ends, np.uint64))))
        return _frame(out, ["bucket", "keys", "docs", "at", "skips", "sizes", "data", "ends"])

    return run


def _later_strings(parts: list[bytes], docs: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, start within it) of the strings that also start earlier, by (document, start), in these parts."""
    size = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.zeros(begin[-1], np.int16)
    symbols[:] = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    symbols += 1
    symbols[begin[1:] - 1] = 0
    classes = window_classes(symbols, length)
    count = size - length + 1
    part = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    c = classes[begin[part] + offset]
    order = np.lexsort((firsts[part] + offset, docs[part], c))
    later = np.ones(len(part), bool)
    later[order[runs(c[order])]] = False
    return part[later], offset[later]


def _spans(chunks: int, length: int):
    """A bucket -> spans of strings that also start earlier, dealt by chunk. Equal stretches count once, at their first place;
    anchors with several stretches are searched by window_classes, some anchors at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, own = pdf[pdf["keys"].isna()], pdf[pdf["keys"].notna()]
        docs, starts, ends = ([from_planes(x) for x in done[c]] for c in ("docs", "at", "ends"))
        if len(own):
            key, doc, at, skip, size = (np.concatenate(list(map(from_planes, own[c]))) for c in ("keys", "docs", "at", "skips", "sizes"))
            doc, at, size = doc.view(np.int64), at.astype(np.int64), size.astype(np.int64)
            data = b"".join(own["data"])
            cut = np.concatenate([[0], np.cumsum(size)])
            ends_at = cut.tolist()
            text = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends_at[:-1], ends_at[1:], strict=True)]), "<u8").reshape(-1, 2)
            order = np.lexsort((at, doc, text[:, 0], text[:, 1], skip, key))
            k, s, t = key[order], skip[order], text[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1]).any(axis=1)])
            again, once = order[~new], order[new]
            docs.append(doc[again].view(np.uint64))
            starts.append(at[again].astype(np.uint64))
            ends.append((at[again] + size[again]).astype(np.uint64))
            several = once[in_larger_runs(key[once])]
            held: list[int] = []
            total = 0

            def resolve() -> None:
                which = np.array(held)
                part, offset = _later_strings([data[ends_at[i] : ends_at[i + 1]] for i in held], doc[which], at[which], length)
                docs.append(doc[which[part]].view(np.uint64))
                starts.append((at[which[part]] + offset).astype(np.uint64))
                ends.append((at[which[part]] + offset + length).astype(np.uint64))
                held.clear()

            for a, b in segments(key[several]):
                more = int(size[several[a:b]].sum())
                if held and total + more > BLOCK_BYTES:
                    resolve()
                    total = 0
                held += several[a:b].tolist()
                total += more
            if held:
                resolve()
        if not docs:
            return _frame([], ["chunk", "docs", "at", "ends"])
        d, a, e = joined_spans(np.concatenate(docs).view(np.int64), np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))
        return _frame(_by_chunk(d.view(np.uint64), a.astype(np.uint64), e.astype(np.uint64), chunks), ["chunk", "docs", "at", "ends"])

    return run


def joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document put together where they overlap or touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    rank = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    base = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * base) - rank * base
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


KEPT = "key long, doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _kept(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    by: dict[int, list] = {}
    if len(spans):
        d, a, e = joined_spans(*(np.concatenate(list(map(from_planes, spans[c]))).view(np.int64) for c in ("docs", "at", "ends")))
        for doc, start, end in zip(d.tolist(), a.tolist(), e.tolist(), strict=True):
            by.setdefault(doc, []).append({"start": start, "end": end})
    rows = []
    for key, doc_id, text in zip(texts["key"], texts["doc_id"], texts["text"], strict=True):
        raw, own, at, kept = text.encode("utf-8", "surrogatepass"), by.get(int(key), []), 0, []
        for s in own:
            kept.append(raw[at : s["start"]])
            at = s["end"]
        kept.append(raw[at:])
        rows.append((key, doc_id, len(raw), own, b"".join(kept)))
    out = _frame(rows, ["key", "doc_id", "n_bytes", "spans", "kept"])
    return out.astype({"key": "Int64", "doc_id": "Int64", "n_bytes": "Int64"})


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, n_bytes, spans (removed: start, end), kept (the other bytes) for each row of docs.

    A text is its UTF-8 bytes. A byte is removed when a string of `length` bytes covers it that also starts earlier: in a
    smaller doc_id, or before in the same document. Strings are judged on the input and don't cross documents.

    1. Every string of `length` bytes has an anchor: its first gram of GRAM bytes with the least hash, about one position in 35.
       Anchors go to hash buckets as packed (hash, document, position); what occurs once is dropped; those with HOT_PLACES
       places or more are told to all tasks (HOT_KEYS at most).
    2. Recurring anchors go back to their documents, where the stretch of text that holds the strings of an anchor is cut out;
       stretches go to the bucket of their anchor, equal ones of a chunk once. So all equal strings meet in a bucket. Hot anchors
       go by more of the bytes around them.
    3. There, equal stretches (by 128-bit hash) become one; anchors with different stretches are resolved by a Burrows-Wheeler
       transform of these: intervals are expanded backward, breadth by breadth, which gives common prefixes by increasing value
       up to `length`. The first string of each class stays, the others are spans.
    4. Spans meet the texts of their chunk again.

    A chunk has about CHUNK_BYTES of text, or one document; a transform about BLOCK_BYTES or one anchor's different stretches, fewer
    than VERY * HOT_PLACES. Texts are searched for anchors in blocks; where one repeats itself within a string's length, however
    long, its strings but the first ones are spans at once (strings). Places are shipped in byte planes; texts are shuffled twice.
    Null and empty texts have no bytes and no spans; texts shorter than `length` lose nothing; rows with the same id are told apart
    and keep the order of ids, null ids come last (see with_key); an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows, bits = keyed_docs(docs, id_col, text_col), bucket_bits(spark)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(n // CHUNK_DOCS, size // CHUNK_BYTES) + 1
    least = max(HOT_PLACES, size // 35 // HOT_KEYS + 1)
    texts = rows.mapInArrow(_with_chunk(chunks), "chunk int, key long, doc_id long, text string")
    places = write_table(rows.mapInArrow(_anchor_entries(bits, length), ENTRIES).groupBy("bucket").applyInPandas(_recurring(chunks, least), PLACES), "places")
    found = places.where("chunk < 0").select("docs", "at").toPandas()
    many = _joined(found["at"]) >= VERY * least
    hot = dict(zip(_joined(found["docs"]).tolist(), np.where(many, VERY_OFFSETS, HOT_OFFSETS).tolist(), strict=True))
    slices = texts.groupBy("chunk").cogroup(places.where("chunk >= 0").groupBy("chunk")).applyInPandas(_slices(bits, chunks, length, hot), SLICES)
    spans = slices.groupBy("bucket").applyInPandas(_spans(chunks, length), PLACES)
    release(spark)
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInPandas(_kept, KEPT)


def _with_chunk(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_chunk(key, chunks), pa.int32()), b.column("key"), b.column("doc_id"), b.column("text")], ["chunk", "key", "doc_id", "text"])

    return run
