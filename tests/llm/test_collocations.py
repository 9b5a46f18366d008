"""Collocations against plain Python and SQL."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from promptloom.llm import collocations as phrases
from promptloom.llm.oracles import COLLOCATIONS

SCHEMA = "doc_id long, text string, lang string, w int, a int, n int, word string, hash int"


def rows(seed=3, n=60):
    """Few words, so that hot prefixes and every kind of overlap arise; odd languages, nulls, repeated ids, a long text."""
    r = random.Random(seed)
    words = ["a", "b", "c", "É", "e", "ab"]
    text = lambda k: " ".join(r.choice(words) if r.random() < 0.9 else r.choice(words).upper() + r.choice(".,;:!?\n\r\t\x0b ") for _ in range(k))
    out = [(i % 50, text(r.choice([0, 1, 3, 50, 400])), r.choice(["en", None, "und", ""]), 1, 2, 3, "x", 4) for i in range(n)]
    return [*out, (98, None, "en", 1, 2, 3, "x", 4), (None, text(5000), "en", 1, 2, 3, "x", 4), (97, " \t..", "de", 1, 2, 3, "x", 4)]


def expected(docs, least=30, top=2000):
    """By counting every phrase."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        longer = [b for (m, v), b in found.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def found(df):
    return sorted(map(tuple, df.collect()))


def test_collocations(spark, monkeypatch):
    docs = rows()
    want = expected(docs)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert len(want) > 100 and found(phrases.collocations(df)) == want
    monkeypatch.setattr(phrases, "MOST_HOT", 3)  # words, pairs and triples are dealt by their extensions
    assert found(phrases.collocations(df)) == want
    assert found(phrases.collocations(df, top=7)) == expected(docs, top=7)
    pdf = pd.DataFrame([d[:3] for d in docs], columns=["doc_id", "text", "lang"])
    con = duckdb.connect()
    con.register("documents", pdf)
    assert sorted(con.execute(COLLOCATIONS).fetchall()) == want
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).collect() == []


@pytest.mark.parametrize("words,size", [(100, 64), (7, 9), (50, 200)])
def test_chunks_cut_texts_anywhere(monkeypatch, words, size):
    """Contexts and counts of small chunks add up to those of one."""
    docs = rows(5)
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"lang": [d[2] or "und" for d in docs], "text": [d[1] or "" for d in docs]}))

    def sums():
        contexts, counts = collections.Counter(), collections.Counter()
        for b in phrases._chunked(iter([batch])):
            for row in b.to_pylist():
                names, cols, times = phrases._read(row)
                for key, t in zip(zip(*(names[c].tolist() for c in cols), strict=True), times.tolist(), strict=True):
                    contexts[row["lang"], key] += t
                for w, k in zip(row["words"].split(b" ") if row["words"] else [], phrases.from_planes(row["counts"]).tolist(), strict=True):
                    counts[row["lang"], w] += k
        return contexts, counts

    whole = sums()
    monkeypatch.setattr(phrases, "CHUNK_WORDS", words)
    monkeypatch.setattr(phrases, "SLICE_BYTES", size)
    assert len(list(phrases._chunked(iter([batch])))) > 20
    parts = sums()
    assert parts[0] == whole[0] and +parts[1] == +whole[1]


def test_heavy_prefixes_are_found():
    """What one prefix has of a bucket's contexts is bounded, however often it occurs."""
    r = random.Random(2)
    text = " ".join("hot pair " + "".join(r.choice("abcdefgh") for _ in range(4)) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(4000))
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"lang": ["en"], "text": [text]}))
    (chunk,) = phrases._chunked(iter([batch]))
    hot = [b for b in phrases._heavy(64)(iter([chunk]))]
    names = pd.concat([b.to_pandas() for b in hot])
    assert (names["n"] > 0).sum() == 3  # "hot", "hot pair", "pair"
    prefixes = names.loc[names["n"] > 0, "prefix"].to_numpy().astype("int64").view("uint64")
    dealt = pd.concat([b.to_pandas() for b in phrases._dealt(6, phrases.np.sort(prefixes))(iter([chunk]))])
    assert dealt["bucket"].nunique() > 40


def test_loads_of_tasks_are_bounded(spark, monkeypatch):
    """Row groups of chunks hold a row; buckets follow the number of contexts, not the partitions; phrases go in small batches."""
    docs = rows(7)
    chunks, bits, write, dealt = [], [], phrases.write_table, phrases._dealt

    def written(df, name, *options):
        out = write(df, name, *options)
        if name == "contexts":
            chunks.extend(out.inputFiles())
        return out

    monkeypatch.setattr(phrases, "write_table", written)
    monkeypatch.setattr(phrases, "_dealt", lambda b, hot: bits.append(b) or dealt(b, hot))
    monkeypatch.setattr(phrases, "BUCKET_CONTEXTS", 4)
    monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", 3)
    assert found(phrases.collocations(spark.createDataFrame(docs, SCHEMA).coalesce(1))) == expected(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in chunks]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 2 and {g.num_rows for g in groups} == {1}
    assert bits[0] > phrases.bucket_bits(spark)


def test_rows_of_a_large_batch_are_taken_one_at_a_time(monkeypatch):
    """A bucket's rows may come in any number of batches, and its phrases go in batches of PHRASES_AT_ONCE."""
    docs = [d for d in rows(5) if d[2] == "en"]
    chunk = next(phrases._chunked(iter([pa.RecordBatch.from_pandas(pd.DataFrame({"lang": ["en"] * len(docs), "text": [d[1] or "" for d in docs]}))])))
    hot = phrases.np.zeros(0, "uint64")
    bucket = pa.Table.from_batches(list(phrases._dealt(1, hot)(iter([chunk])))).to_batches(max_chunksize=1)
    whole = [r for b in phrases._grown(hot, 30)(iter(bucket)) for r in b.to_pylist()]
    monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", 5)
    parts = list(phrases._grown(hot, 30)(iter(bucket)))
    assert [r for b in parts for r in b.to_pylist()] == whole
    assert len(whole) > 20 and {b.num_rows for b in parts[:-1]} == {5}
