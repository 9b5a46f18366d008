"""Operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptloom.llm import bwt, rans
from promptloom.llm import suffix_dedup as suffixes
from promptloom.llm.common import new_path
from promptloom.llm.jaccard import components, jaccard_groups
from promptloom.llm.keyed import with_key
from promptloom.llm.lines import line_dedup
from promptloom.llm.packing import FAN_IN, _dealt, pack
from promptloom.llm.pieces import Pieces, boundary_states, decode, encode, multiply
from promptloom.llm.quality import quality_features, risk_controlled
from promptloom.llm.sharding import kd_shards
from promptloom.llm.suffix_dedup import suffix_dedup
from promptloom.llm.token_counts import token_counts
from promptloom.llm.token_file import document_checks, read_token_file, write_token_file
from promptloom.llm.tokens import token_ids
from promptloom.llm.topk import top_k
from promptloom.llm.trie import Trie

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, part int, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    """documents with columns whose names the operators use, too."""
    rows = [(i if ids is None else ids[i], t, ["en", None, "de"][i % 3], ["src0", "src0", "src1", None][i % 4], 7, 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared lines and passages, odd characters, and a long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    line = lambda k: " ".join(word() for _ in range(k))
    boiler, passage = [line(6) for _ in range(3)], line(40)
    out = [None, "", " \n\t", "one", "two words", "A B\x0bC\x0cD\rE", "ﬁ ① 漢字 😀 é", "<|endoftext|> x", "x" * 3000, "ab " * 400]
    while len(out) < n:
        t = "\n".join(line(r.randint(1, 12)) for _ in range(r.randint(1, 6)))
        t += "\n" + r.choice(boiler) if r.random() < 0.4 else ""
        t += " " + passage if r.random() < 0.2 else ""
        out.append(t)
        if r.random() < 0.3:
            out.append(t)
        if r.random() < 0.4:
            w = t.split(" ")
            w[r.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    return [*out, line(6000), line(6000)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_ids_are_the_librarys():
    r = random.Random(5)
    bits = ["a", "Z", " ", "  ", "\n", "\t", "é", "é", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "1", "23", "!", ",", ". ", "\x1c", "\x85", "漢字", "😀", "ß", "İ", "Σ", "\r\n", "\0", "ﬁ", "̈", "﻿"]
    texts = [t for t in corpus() if t] + ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for path in (BYTES, WORDS):
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        mine = token_ids(path)
        assert [np.frombuffer(mine.ids(t), "<u4").tolist() for t in texts] == want
        assert [f[o[i] : o[i + 1]].tolist() for f, o in mine.batches(texts) for i in range(len(o) - 1)] == want


def test_token_counts_and_cache(spark, docs, none):
    lib, cache = Tokenizer.from_file(BYTES), new_path(spark, "cache")
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(corpus())))
    got = lambda d: sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(d, BYTES, cache).collect())
    assert got(docs.where("doc_id % 2 = 0")) == want[::2]
    rows = lambda: spark.read.parquet(f"{cache}/*").count()
    half = rows()
    assert half == len({t or "" for t in corpus()[::2]})
    assert got(docs) == want and rows() == len({t or "" for t in corpus()}) > half
    full = rows()
    assert got(docs) == want and rows() == full and got(none) == []


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, n):
    """A chain of edits: neighbours are similar, ends are not."""
    r = random.Random(seed)
    w, out = [f"w{r.randrange(10**6)}" for _ in range(120)], []
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("texts", [corpus(), near_copies(3, 60) + near_copies(4, 20) * 2, ["same"] * 9 + [None, ""]], ids=["corpus", "chains", "copies"])
def test_jaccard_groups(spark, texts):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, texts).repartition(4)).collect())
    assert got == groups(texts)


def test_jaccard_repeated_and_null_ids(spark, none):
    t = near_copies(5, 3)
    d = table(spark, [t[0], t[0], "other", t[1]], [5, 5, None, 7])
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard_groups(d).collect())
    assert got == {(5, 5): 2, (None, None): 1, (7, 5): 1}
    assert jaccard_groups(none).collect() == []


@pytest.mark.parametrize("order", ["ascending", "shuffled"])
def test_components_take_few_rounds(spark, monkeypatch, order):
    n, rounds = 2000, []
    from promptloom.llm import jaccard

    write = jaccard.write_table
    monkeypatch.setattr(jaccard, "write_table", lambda df, name: (rounds.append(name), write(df, name))[1])
    names = list(range(n))
    if order == "shuffled":
        random.Random(1).shuffle(names)
    links = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1) if i != 1200], "a long, b long")
    got = {r.set: r.comp for r in components(spark.range(n + 3).select(F.col("id").alias("set"), F.col("id").alias("comp")), links).collect()}
    low, high = names[:1201], names[1201:]
    assert got == {**{x: min(low) for x in low}, **{x: min(high) for x in high}, **{x: x for x in range(n, n + 3)}}
    assert rounds.count("labels") <= 15


def near_template(seed, n):
    """Texts that share most of a template and stay unlinked but for some pairs."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(0, 300, 6), 8):
            w[at] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [out[3].replace("t7 ", "y "), out[5]]


def test_jaccard_of_sets_that_share_a_template(spark):
    texts = near_template(8, 70)
    want = groups(texts)
    assert 1 < sum(i != c for i, _, c in want) < len(texts) // 2
    for partitions in ("3", "37"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, texts)).collect())
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == want


def test_trie_finds_all_similar_sets():
    r = random.Random(7)
    sets = [sorted(r.sample(range(40), r.randint(1, 25))) for _ in range(150)]
    trie = Trie(60)
    for i, s in enumerate(sets):
        trie.add(i, np.array(s, np.uint64), len(s))
    for s in sets:
        want = {i for i, o in enumerate(sets) if 100 * len({*s} & {*o}) >= 60 * len({*s} | {*o})}
        assert {i for i, _ in trie.similar(np.array(s, np.uint64), len(s))} == want


def removed(texts, length):
    seen, out = set(), []
    for i, t in enumerate(texts):
        b, spans = (t or "").encode(), []
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w not in seen:
                seen.add(w)
            elif spans and k <= spans[-1][1]:
                spans[-1][1] = k + length
            else:
                spans.append([k, k + length])
        keep = [True] * len(b)
        for x, y in spans:
            keep[x:y] = [False] * (y - x)
        out.append((i, [tuple(s) for s in spans], bytes(c for c, k in zip(b, keep, strict=True) if k)))
    return out


@pytest.mark.parametrize("texts", [corpus(), corpus(9, 30) + ["ab" * 400, "xab" * 90, "a" * 99, "a" * 100, "a" * 101], ["q" * 500] * 3], ids=["corpus", "periodic", "copies"])
def test_suffix_dedup(spark, texts):
    got = sorted((r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(table(spark, texts).repartition(4)).collect())
    assert got == removed(texts, 100)


def test_anchors_in_many_surroundings(spark, monkeypatch):
    """A phrase that is shorter than the strings, and one that is about as long, in texts that have nothing else in common; and
    passages around it that do recur."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    line = lambda k: " ".join(word() for _ in range(k))
    short, long = line(6), line(12)[:95]
    around = f"{line(9)} {short} {line(9)}"
    texts = [f"{line(12)} {r.choice([short, long])} {line(12)}" + (f" {around}" if i % 9 == 0 else "") for i in range(160)]
    want = removed(texts, 100)
    assert sum(bool(s) for _, s, _ in want) > 10
    monkeypatch.setattr(suffixes, "HOT_PLACES", 12)
    for very in (3, 1000):
        monkeypatch.setattr(suffixes, "VERY", very)
        got = sorted((x.doc_id, [(s.start, s.end) for s in x.spans], bytes(x.kept)) for x in suffix_dedup(table(spark, texts).repartition(3)).collect())
        assert got == want


def test_suffix_dedup_repeated_ids(spark, none):
    t = corpus()[-1]
    rows = suffix_dedup(table(spark, [t, t, None], [4, 4, None])).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 0, len(t.encode())] and suffix_dedup(none).collect() == []


def test_window_classes():
    r = random.Random(3)
    for _ in range(150):
        n, k = r.choice([1, 2, 3, 5, 8, 12]), r.choice([1, 2, 3, 26])
        words = [[r.randrange(k) + 1 for _ in range(r.randint(0, 40))] for _ in range(r.randint(1, 12))]
        symbols = np.array([c for w in words for c in [*w, 0]])
        classes = bwt.window_classes(symbols, n)
        by, back = {}, {}
        for i in range(len(symbols) - n + 1):
            if 0 not in (w := tuple(symbols[i : i + n])):
                assert by.setdefault(w, classes[i]) == classes[i] and back.setdefault(classes[i], w) == w


def counted(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_features(spark, docs, none):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_features(docs).collect()}
    assert got == {i: counted(t) for i, t in enumerate(corpus())} and quality_features(none).collect() == []


def binomial_bound(n, k, error):
    """The share whose chance of k or fewer among n is error, by bisection."""
    from math import comb

    lo, hi = 0.0, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > error else (lo, p)
    return hi


def test_cutoffs_keep_to_the_bound(spark, none):
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(40)) + (" ### |||" * 20 if i % 4 == 0 or r.random() < 0.01 else "") for i in range(1500)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(1500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    f = quality_features(d).cache()
    rows = risk_controlled(f, labels).collect()
    cut = rows[0].cutoff
    assert cut is not None
    half = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 2
    held = [x for x in rows if half(x.doc_id) and x.doc_id % 4]
    assert binomial_bound(len(held), sum(x.score >= cut for x in held), 0.05 / 20) <= 0.05 + 1e-9
    assert sum(not x.kept for x in rows if x.doc_id % 4 == 0) > 300 and sum(x.kept for x in rows if x.doc_id % 4) > 1050
    few = risk_controlled(f, labels.limit(40)).collect()
    assert all(x.cutoff is None and x.kept != x.base_failed for x in few)
    assert all(x.kept != x.base_failed for x in risk_controlled(f, labels.limit(0)).collect())
    assert risk_controlled(quality_features(none), labels).collect() == []


def test_kd_shards(spark, docs, none):
    texts = corpus(n=150)[:-2]
    got = kd_shards(table(spark, texts), 5).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(5)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(x.size for x in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 3 * max(r.size for r in got)
    assert kd_shards(none, 5).collect() == []
    odd = kd_shards(table(spark, ["a", "b", None], [1, 1, None]), 4).collect()
    assert len(odd) == 3 and len({(r.shard, r.slot) for r in odd}) == 3


def naive_kd(rows, n_shards):
    """rows: dicts with k, text_crc32, row, size and the string dimensions -> row number: shard."""
    dims = [d for d in rows[0] if d not in ("text_crc32", "row")]
    span = {d: max(1, max(x[d] for x in rows) - min(x[d] for x in rows)) for d in dims}
    out = {}

    def split(part, first, n):
        if n == 1 or not part:
            out.update({x["row"]: first for x in part})
            return
        dim = max(dims, key=lambda d: (max(x[d] for x in part) - min(x[d] for x in part)) / span[d])
        part = sorted(part, key=lambda x: (x[dim], x["k"], x["text_crc32"], x["row"]))
        target, below, at = sum(x["size"] for x in part) * (n // 2) // n, 0, 0
        while below + part[at]["size"] < target:
            below += part[at]["size"]
            at += 1
        at += target - below > below + part[at]["size"] - target
        split(part[:at], first, n // 2)
        split(part[at:], first + n // 2, n - n // 2)

    split(rows, 0, n_shards)
    return out


@pytest.mark.parametrize("n_shards", [5, 24])
def test_kd_shards_are_those_of_a_naive_tree(spark, n_shards):
    texts = [*corpus(4, 150)[:-2], *corpus(5, 90)]
    prefix = lambda s: -1 if s is None else int.from_bytes(s.encode()[:7].ljust(7, b"\0"), "big")
    d = table(spark, texts).coalesce(1)
    rows = [{"k": x.doc_id, "size": len((x.text or "").encode()) + 8, "d0": prefix(x.source), "d1": prefix(x.lang), "text_crc32": zlib.crc32((x.text or "").encode()), "row": x.doc_id} for x in d.collect()]
    assert {x.doc_id: x.shard for x in kd_shards(d, n_shards).collect()} == naive_kd(rows, n_shards)


def test_kd_shards_split_a_hot_id(spark):
    d = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = kd_shards(d, 8).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert len(got) == 8 and sum(x.n for x in got) == 4000 and all(x.top == x.n - 1 for x in got)
    assert max(x.size for x in got) - min(x.size for x in got) <= 26


def test_kd_shards_balance_with_a_hot_source(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"), F.lit("en").alias("lang"))
    sizes = [r["sum(size)"] for r in kd_shards(d, 24).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) / min(sizes) < 1.06


def test_top_k(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=40).round(3).tolist()) for i in range(400)] + [(400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [float("inf")]), (404, []), (405, [1.0, 2.0]), (None, [1.0])]
    vectors += [(7 * i, vectors[i][1]) for i in range(60, 70)]  # ties
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").dropDuplicates(["vec_id"]).cache()
    got = collections.defaultdict(list)
    for x in top_k(d, d.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    fine = {x.vec_id: np.floor(64 * np.pad(np.array(x.embedding, np.float32).astype(float), (0, 40 - len(x.embedding)))) for x in d.collect() if x.vec_id is not None and x.embedding is not None and not any(v is None or not np.isfinite(v) for v in x.embedding)}
    for q, v in fine.items():
        if q % 20 == 0:
            assert got.pop(q) == sorted(((i, int(v @ w)) for i, w in fine.items() if i != q), key=lambda p: (-p[1], p[0]))[:20]
    assert not got and top_k(d.limit(0), d.limit(0)).collect() == []


def test_top_k_of_repeated_and_large_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [1e9, -1e9]), (2, [1e9, 1e9 + 64]), (3, [1e300, 0.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(d, d.where("vec_id % 20 = 0"), 2).collect()}
    high = (1 << 63) - 1
    assert got[0, 1] == (3, high) and got[0, 2] == (2, 192 * 64 * 10**9 + 64 * (64 * 10**9 + 4096))
    assert got[20, 1] == (3, high) and got[20, 2] == (2, 32 * (2 * 64 * 10**9 + 4096))


def test_suffix_dedup_keeps_the_order_of_ids(spark):
    """Rows with one id, before and after other ids: the smaller id is earlier, and of one id's rows one is first."""
    r = random.Random(8)
    line = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(k))
    shared, late = line(25), line(25)
    rows = [(5, f"{line(9)} {shared}"), (5, f"{line(9)} {shared}"), (10, f"{line(9)} {shared}"), (3, f"{line(5)} {late}"), (12, f"{late} {line(4)}"), (12, f"{late} {line(3)}"), (None, f"{line(2)} {late}")]
    got = [(x.doc_id, sum(s.end - s.start for s in x.spans)) for x in suffix_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)).collect()]
    lost = {i: sorted(n for d, n in got if d == i) for i, _ in rows}
    assert lost[3] == [0] and lost[5][0] == 0 and lost[5][1] >= 199 and lost[10][0] >= 199
    assert all(n >= 199 for n in (*lost[12], *lost[None]))
    ids = [i for i, _ in rows]
    kept = {x.doc_id: x.n_dropped for x in line_dedup(table(spark, ["a line that all of these share"] * 7, ids)).where("n_dropped = 0").collect()}
    assert kept == {3: 0}


def test_keys_keep_the_order_of_ids(spark):
    ids = [7, -3, 7, None, 0, None, 7, 9, -3]
    for more in ([], [1 << 62]):  # the last ones leave no room for multiples
        rows = with_key(table(spark, [str(i) for i in range(len(ids + more))], ids + more).drop("key").repartition(4)).orderBy("key").collect()
        found = [x.doc_id for x in rows]
        assert found == [*sorted(i for i in ids + more if i is not None), None, None] and len({x.key for x in rows}) == len(rows)


def test_strings_of_periodic_texts(monkeypatch):
    """Every string that is not a span at once has its first start in an anchor's range, whatever the blocks; spans are right."""
    monkeypatch.setattr(suffixes, "BLOCK_STARTS", 500)
    monkeypatch.setattr(suffixes, "PERIODIC", 4)
    for seed in range(12):
        r = random.Random(seed)
        raw = b""
        for _ in range(6):
            unit = bytes(r.randrange(97, 123) for _ in range(r.choice([1, 2, 3, 7, 30, 60, 150])))
            raw += unit * r.choice([1, 3, 300 // len(unit) + 1, 1500 // len(unit) + 1]) + bytes(r.randrange(97, 123) for _ in range(r.randrange(300)))
        _, at, first, last, starts, ends = suffixes.strings(np.frombuffer(raw, np.uint8))
        again = np.zeros(len(raw), bool)
        for a, b in removed([raw.decode()], 100)[0][1]:
            again[a:b] = True
        assert all(again[a:b].all() for a, b in zip(starts, ends, strict=True))
        owned = np.zeros(len(raw), bool)
        for a, b in zip(first, last, strict=True):
            owned[a : b + 1] = True
        seen = set()
        for i in range(len(raw) - 99):
            assert raw[i : i + 100] in seen or owned[i]
            seen.add(raw[i : i + 100])
        assert set(at) <= set(suffixes.strings(np.frombuffer(raw, np.uint8), owners=False)[1])
    monkeypatch.undo()
    for unit in (b"x", b"ab"):  # a few anchors, whatever the length
        long = np.frombuffer(unit * ((4 << 20) // len(unit)), np.uint8)
        _, at, _, _, starts, ends = suffixes.strings(long)
        assert len(at) <= len(unit) and starts.tolist() == [len(unit)] and ends.tolist() == [len(long)]


def test_suffix_dedup_of_long_periodic_texts(spark):
    texts = ["x" * 3_000_000, "-=" * 1_000_000 + "end", "x" * 150]
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], len(r.kept)) for r in suffix_dedup(table(spark, texts)).collect()}
    assert got == {0: ([(1, 3_000_000)], 1), 1: ([(2, 2_000_000)], 5), 2: ([(0, 150)], 0)}


def test_trie_leaves_what_is_joined():
    r = random.Random(4)
    sets = [sorted(r.sample(range(40), r.randint(10, 14))) for _ in range(150)]
    group = list(range(150))

    def of(g):
        while group[g] != g:
            g = group[g]
        return g

    trie, plain = Trie(60, of), Trie(60)
    for i, s in enumerate(sets):
        t = np.array(s, np.uint64)
        near = {j for j, _ in plain.similar(t, len(s))}
        for j, _ in trie.similar(t, len(s), i):
            assert j in near and of(i) != of(j)
            group[max(of(i), of(j))] = min(of(i), of(j))
        assert all(of(j) == of(i) for j in near)
        trie.add(i, t, len(s), i)
        plain.add(i, t, len(s))


def test_line_dedup(spark, none):
    head = [f"User {i} logged in from host {i * 7} today" for i in range(6)]
    texts = [f"{chr(97 + i)}{chr(98 + i)} stays where it is\n{head[i]}\n\nshort line\nAll rights of this page reserved" for i in range(6)] + [None, "", head[0]]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup(table(spark, texts)).collect()}
    assert got[0] == (5, 0, texts[0])
    assert all(got[i] == (5, 3, f"{chr(97 + i)}{chr(98 + i)} stays where it is\n") for i in range(1, 6))
    assert got[6] == got[7] == (1, 0, "") and got[8] == (1, 1, "")
    names = ["ann", "bob", "cid", "dan"]
    made = [f"the cat sat on the mat with {x} again and slept" for x in names] + ["the cat sat under seven big trees while rain came down"]
    assert [r.n_dropped for r in line_dedup(table(spark, made)).orderBy("doc_id").collect()] == [0, 1, 1, 1, 0]
    assert line_dedup(none).collect() == []


def test_line_dedup_of_odd_rows(spark):
    text, long = "one line that stays here\nand a second one too", "w " * 50_000 + "end"
    rows = line_dedup(table(spark, [text, text, text, long, f"{long}\nx", long, None], [3, 3, None, None, 5, 6, 6])).collect()
    assert sorted((r.n_lines, r.n_dropped) for r in rows) == [(1, 0), (1, 1), (1, 1), (2, 0), (2, 0), (2, 2), (2, 2)]


def dropped(spark, texts):
    return [r.n_dropped for r in line_dedup(table(spark, texts)).orderBy("doc_id").collect()]


def test_other_lines_of_a_leaf_hide_no_template(spark, none):
    names = ["ann", "bob", "cid", "dan"]
    made = [f"the cat sat on the mat with {x} again and slept" for x in names]
    other = ["the cat sat " + " ".join(f"{w}{chr(97 + i)}" for w in "pqrstuvw") for i in range(9)]
    assert dropped(spark, made + other) == [0, 1, 1, 1] + [0] * 9
    assert dropped(spark, [*made, "\n".join(other)]) == [0, 1, 1, 1, 0]
    second = [f"the cat sat under seven big trees {x} rain came down" for x in names]
    assert dropped(spark, made + second + other[:1]) == [0, 1, 1, 1, 0, 1, 1, 1, 0]
    two = [f"the cat sat on {y} mat with {x} again and slept" for x, y in zip(names, "abcd", strict=True)]
    assert dropped(spark, two + other) == [0, 1, 1, 1] + [0] * 9
    often = ["the cat sat " + " ".join(f"{w}{chr(97 + i)}" for w in "pqrs") + f" {x} " + " ".join(f"{w}{chr(97 + i)}" for w in "uvw") for x in names for i in range(9)]
    assert sum(dropped(spark, often)) == 27 and sum(dropped(spark, made + often)[:4]) == 3
    assert dropped(spark, made[:2] + other) == [0] * 11
    assert line_dedup(none).collect() == []


def test_short_lines_and_lines_of_two_documents_recur(spark):
    only = [" ".join(f"{w}{chr(97 + i)}" for w in "pqrst") for i in range(3)]
    assert dropped(spark, [f"Read more\n}}\n\n{x}" for x in only]) == [0, 1, 1]
    assert dropped(spark, [f"Read more\n{x}" for x in only[:2]]) == [0, 0]
    assert dropped(spark, [f"{x}\nthe same line in both" for x in only[:2]]) == [0, 1]
    assert dropped(spark, [f"{x}\nwe saw them all on day {i}" for i, x in enumerate(only[:2])]) == [0, 1]


def test_lines_of_fields_recur_unmasked_only(spark):
    rows = [f"{i} {i + 1} {i + 2} {i * 3}\non {i} of {i} and {i}\nrow {i} of the same long table" for i in range(10, 14)]
    assert dropped(spark, rows) == [0, 1, 1, 1]
    assert dropped(spark, [*rows, rows[0]]) == [0, 1, 1, 1, 3]


def test_rans_round_trip_and_damage():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.3, 200_000), 49_000).astype(np.uint32)
    model = rans.Model(*rans.frequencies(*np.unique(ids, return_counts=True)))
    blocks = [ids[:65_536], ids[65_536:131_072], ids[:5], ids[:0], ids[:40_000], ids[:32_768]]
    packed = model.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, model.decode(packed), strict=True))
    with pytest.raises(ValueError, match="checksum"):
        model.decode([packed[0][:100] + b"\0\0\0\0" + packed[0][104:]])
    a, b = b"hello" * 7, b"world" * 900
    assert rans.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    shares = rans.frequencies(np.arange(40_000), np.array([10**9] + [1] * 39_999))[1]
    assert shares.sum() == 1 << 20 and shares.min() == 1


def test_token_file(spark, none):
    lib = Tokenizer.from_file(WORDS)
    texts = [*corpus(), " ".join(f"w{i}" for i in range(60_000))]
    path = new_path(spark, "file")
    write_token_file(table(spark, texts).repartition(3), path, WORDS, 2)
    start, want = 0, []
    for i, t in enumerate(texts):
        a = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    got = document_checks(read_token_file(spark, path, checks=True)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want and want[-1][2] > 2 * rans.BLOCK
    ids = read_token_file(spark, path).orderBy("piece_start").collect()
    assert sum(len(r.ids) for r in ids) == 4 * start
    empty = new_path(spark, "file")
    write_token_file(none, empty, WORDS, 2)
    assert document_checks(read_token_file(spark, empty, checks=True)).collect() == []


def test_counts_and_files_of_repeated_and_null_ids(spark):
    d = table(spark, ["a b", "a b", None, "c", "longer text here"], [2, 2, None, None, 1])
    counts = collections.Counter((r.doc_id, r.n_bytes) for r in token_counts(d, BYTES, new_path(spark, "cache")).collect())
    assert counts == {(2, 3): 2, (None, 0): 1, (None, 1): 1, (1, 16): 1}
    path = new_path(spark, "file")
    write_token_file(d, path, WORDS, 2)
    rows = document_checks(read_token_file(spark, path, checks=True)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 2] and rows[3].ids_crc32 == rows[4].ids_crc32
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]


@pytest.mark.parametrize("keep", [1, 8])
def test_packing(spark, none, keep):
    lib, texts = Tokenizer.from_file(WORDS), corpus()
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    rows = pack(table(spark, texts).repartition(20), WORDS, 1, 128, keep).collect()
    seqs, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
    tiles = lambda v: all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:], strict=False)) and min(v)[0] == 0
    assert all(map(tiles, seqs.values())) and all(map(tiles, parts.values())) and all(sum(n for _, n in v) <= 128 for v in seqs.values())
    assert all(sum(n for _, n in parts[i]) == len(x) for i, x in ids.items())
    if keep == 8:
        assert sum(map(len, ids.values())) > 0.9 * 128 * len(seqs)
    assert pack(none, WORDS, 1).collect() == [] and len(pack(table(spark, ["a", "a"], [None, None]), WORDS, 1).collect()) == 2


def naive_pack(pieces, size, keep, last):
    """Windows of pieces (doc_id, start, length): best fit, the latest of equal ones; the fullest leaves when none fits."""
    shut, held, clock = [], [], 0
    for p in pieces:
        if p[2] >= size:
            shut.append([p])
            continue
        fits = [w for w in held if w["free"] >= p[2]]
        if fits:
            w = min(fits, key=lambda w: (w["free"], -w["at"]))
        else:
            if len(held) >= keep:
                full = min(held, key=lambda w: (w["free"], -w["at"]))
                held.remove(full)
                shut.append(full["in"])
            w = {"free": size, "in": []}
            held.append(w)
        clock += 1
        w["in"].append(p)
        w["free"], w["at"] = w["free"] - p[2], clock
        if not w["free"]:
            held.remove(w)
            shut.append(w["in"])
    rest = [w["in"] for w in held]
    return (shut + rest, []) if last else (shut, rest)


@pytest.mark.parametrize("keep", [1, 3, 20])
def test_packing_is_that_of_a_naive_packer(spark, keep):
    lib, texts, size = Tokenizer.from_file(WORDS), corpus(2, 120), 96
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    pieces = [(i, at, min(size, k - at)) for i, k in enumerate(n) for at in range(0, k, size)]
    first, rest = naive_pack(pieces, size, keep, False)
    again, _ = naive_pack(sorted((p for w in rest for p in w), key=lambda p: (-p[2], p[0], p[1])), size, keep, True)
    got = collections.defaultdict(list)
    for r in pack(table(spark, texts).coalesce(1), WORDS, 1, size, keep).collect():
        got[r.sequence_id].append((r.offset, (r.doc_id, r.start, r.length)))
    assert sorted([p for _, p in sorted(w)] for w in got.values()) == sorted(first + again)


@pytest.mark.parametrize("tasks", [3, 8, 9, 64, 130])
def test_leftovers_of_few_tasks_meet(spark, tasks):
    n = -(-tasks // FAN_IN)
    rest = spark.range(0, tasks * 4).select(((F.col("id") % tasks) * (1 << 32) + F.col("id")).alias("sequence_id"), (F.col("id") % tasks).alias("task"))
    met = _dealt(rest, n).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("task").alias("n"))
    got = [r.n for r in met.collect()]
    assert len(got) == n and max(got) <= FAN_IN and sum(got) == tasks


def test_max_plus_products_find_the_best_path():
    """A lattice of weighted pieces: chunks' matrices, combined, against one pass over the whole text."""
    r = random.Random(12)
    for _ in range(60):
        score = {p: r.uniform(-9, -1) for p in {"a", "b", *("".join(r.choice("ab") for _ in range(r.randint(2, 5))) for _ in range(12))}}
        s = "".join(r.choice("ab") for _ in range(r.randint(1, 60)))

        def reach(start, stop):
            """Best score of each place at stop or later, by pieces that begin before stop."""
            best = {start: 0.0}
            for at in range(start, stop):
                for k in range(1, 6):
                    if at in best and s[at : at + k] in score and at + k <= len(s):
                        best[at + k] = max(best.get(at + k, -np.inf), best[at] + score[s[at : at + k]])
            return {e: v for e, v in best.items() if e >= stop}

        chunk, matrices, enter = r.choice([1, 2, 3, 7, 20]), [], [0]
        for p in range(0, len(s), chunk):
            q = min(len(s), p + chunk)
            m = {(e, None): {(x, None): v for x, v in (reach(e, q) if e < q else {e: 0.0}).items()} for e in enter}
            matrices.append(m)
            enter = sorted({x for row in m.values() for x, _ in row})
        states = boundary_states(matrices)
        total = sum(m[a][b] for m, a, b in zip(matrices, states, states[1:], strict=False))
        assert states[0] == (0, None) and states[-1] == (len(s), None) and total == pytest.approx(reach(0, len(s))[len(s)])
        if len(matrices) > 2:
            a, b, c = matrices[:3]
            left, right = multiply(multiply(a, b), c), multiply(a, multiply(b, c))
            assert {i: pytest.approx(v) for i, v in left.items()} == right


def test_pieces_scan_is_the_librarys_result():
    m, r = Pieces(PIECES), random.Random(2)
    bits = ["the", "ing", " ", "  ", "a", "b", "er", "é", "漢字", "\n", "1", "00", ".", ",", "▁", "😀", "ion", "tion", "un", "s"]
    for t in [x[:400] for x in corpus() if x] + ["".join(r.choice(bits) for _ in range(r.randint(1, 80))) for _ in range(300)] + ["".join(r.choice("aetinors") for _ in range(200)) for _ in range(20)]:
        s, chunk = m.normal(t), r.choice([1, 2, 3, 5, 7, 17, 40, 64])
        cuts = [(p, min(len(s), p + chunk)) for p in range(0, len(s), chunk)]
        states = boundary_states([m.matrix(s, p, q) for p, q in cuts])
        assert [i for (p, q), a, b in zip(cuts, states, states[1:], strict=False) for i in m.between(s, q, a, b)] == m.lib.encode(t)


def test_pieces_encode_and_decode(spark, docs, none):
    m, texts = Pieces(PIECES), corpus()
    parts = collections.defaultdict(list)
    for r in decode(encode(docs, PIECES, chunk=500), PIECES).orderBy("part").collect():
        parts[r.doc_id].append(r)
    assert len(parts) == len(texts) and max(map(len, parts.values())) > 10
    for i, t in enumerate(texts):
        assert np.frombuffer(b"".join(r.ids for r in parts[i]), "<u4").tolist() == m.lib.encode(t or "")
        assert b"".join(r.data for r in parts[i]).decode() == (t or "")
    assert encode(none, PIECES).collect() == []


def test_pieces_work_in_small_slices():
    """op6: what a worker encodes, cuts or decodes goes on in small batches, however large the one is that Spark gave it."""
    import pyarrow as pa

    from promptloom.llm import pieces

    m, text = Pieces(PIECES), "the inging of tion " * 300
    docs = pa.record_batch({"key": pa.array(range(2000), pa.int64()), "doc_id": pa.array(range(2000), pa.int64()), "text": [text] * 2000})
    done = list(pieces._whole(PIECES)(iter([docs])))
    assert sum(b.num_rows for b in done) == 2000 and len(done) > 9 and max(b.num_rows for b in done) < 200
    assert all(np.frombuffer(x, "<u4").tolist() == m.lib.encode(text) for x in {x for b in done for x in b.column("ids").to_pylist()})
    cut = list(pieces._cut(PIECES, 1000)(iter([docs.slice(0, 400)])))
    chunks = pa.Table.from_batches(cut).combine_chunks().to_batches()
    found = list(pieces._matrices(PIECES)(iter(chunks)))
    assert chunks[0].num_rows == 400 * 6 and len(found) > 1 and {(k, p) for b in found for k, p in zip(b.column("key").to_pylist(), b.column("part").to_pylist(), strict=True)} == {(k, p) for k in range(400) for p in range(6)}
