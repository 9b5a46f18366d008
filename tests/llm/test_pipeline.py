"""Stages of the pipeline on a small fixture, each against brute force on its own input."""

from __future__ import annotations

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import test_operators as T
from test_llm_entry import labelled

import corpus_pipeline as P
from promptloom.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(4)
    texts = [*T.corpus(11, 50), *(" ".join(f"v{r.randrange(10**6)}" for _ in range(60)) for _ in range(20)), "short", "# | # | " * 40]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def without_recurring_lines(docs):
    """The rules of recurring_lines in plain Python: docs without the lines that they drop."""
    lines = []  # doc, line, form, tokens of the masked form, leaf, few tokens
    for d, t in enumerate(docs):
        for k, x in enumerate(t.split("\n")):
            c = re.sub(r"[ \t\x0b\f\r]+", " ", x).strip(" ")
            n = c.count(" ") + 1
            if n < 4 and not any(ch.isalnum() for ch in c):
                continue
            masked = re.sub(r"[^ ]*[0-9][^ ]*", "<*>", c)
            tokens = masked.split(" ")
            enough = 100 * sum(x != "<*>" for x in tokens) >= 70 * n
            lines.append((d, k, masked if enough else c, tokens, (n, *tokens[:3]) if enough and n >= 4 else None, n < 4))
    forms, leaves, drop = collections.defaultdict(set), collections.defaultdict(list), set()
    for d, _, form, *_, few in lines:
        forms[form, few].add(d)
    for d, k, form, _, leaf, few in lines:
        has = forms[form, few]
        if len(has) >= (3 if few else 2) and d != min(has):
            drop.add((d, k))
        if leaf:
            leaves[leaf].append((d, k, form))
    mixed = {leaf for leaf, v in leaves.items() if len({f for *_, f in v}) > 1 and len({d for d, *_ in v}) >= 3}
    words = lambda tokens: [(at, x) for at, x in enumerate(tokens) if x != "<*>"]
    support = collections.defaultdict(set)
    for d, _, _, tokens, leaf, _ in lines:
        if leaf in mixed:
            for w in words(tokens):
                support[leaf, w].add(d)
    ways = collections.defaultdict(set)
    for d, k, _, tokens, leaf, _ in lines:
        if leaf in mixed:
            n, often = len(tokens), {w: len(support[leaf, w]) for w in words(tokens) if len(support[leaf, w]) >= 3}
            if len(often) == len(words(tokens)) and 100 * (len(often) - 1) >= 70 * n:
                for w in often:
                    ways[leaf, frozenset(often) - {w}].add((d, k))
            for least in set(often.values()):
                top = frozenset(w for w, s in often.items() if s >= least)
                if 100 * len(top) >= 70 * n:
                    ways[leaf, top].add((d, k))
    for has in ways.values():
        if len({d for d, _ in has}) >= 3:
            drop |= {(d, k) for d, k in has if d != min(has)[0]}
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in drop) for d, t in enumerate(docs)]


def packed_whole(rows, docs):
    """Every id of every document lies in one piece; pieces fill their sequences without gaps."""
    lib = T.Tokenizer.from_file(T.WORDS)
    ids = collections.Counter((r.doc_id, np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs)
    want = collections.Counter()
    starts = collections.defaultdict(set)
    for r in rows:
        starts[r.doc_id, r.doc_tokens].add((r.start, r.length))
    for (doc, data), n in ids.items():
        cuts = sorted(s for s in starts[doc, len(data) // 4] if s[0] + s[1] <= len(data) // 4)
        assert cuts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(cuts, [*cuts[1:], (len(data) // 4, 0)], strict=True))
        want.update({(doc, a, k, zlib.crc32(data[4 * a : 4 * (a + k)])): n for a, k in cuts})
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= 2048 for v in map(sorted, seqs.values()))


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, seen[-1], folder)
        assert tuple(out.columns) == P.COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    full, quality, lines, near, passages = map(texts, seen)
    assert set(quality) == {i for i, t in full.items() if not T.counted(t)[5]} and all(quality[i] == full[i] for i in quality)
    order = sorted(quality)
    kept = without_recurring_lines([quality[i] or "" for i in order])
    assert lines == {i: t for i, t in zip(order, kept, strict=True) if t == (quality[i] or "") or T.WORD.search(t)}
    assert any(lines.get(i) != quality[i] for i in order)
    order = sorted(lines)
    first = {order[i] for i, _, c in T.groups([lines[i] for i in order]) if i == c}
    assert set(near) == first and all(near[i] == lines[i] for i in near)
    order = sorted(near)
    kept = {order[i]: k.decode("utf-8", "ignore") for i, s, k in T.removed([near[i] for i in order], 100) if not s or k}
    assert passages == kept
    assert all(r.n_chars == len(r.text) for r in seen[-1].collect() if r.text is not None)
    packed_whole(P.STAGES[-1][1](spark, seen[-1], folder).collect(), seen[-1].collect())


def test_run(spark, folder):
    rows, docs = P.run(spark, folder).collect(), spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    packed_whole(rows, docs.collect())


def test_quality_stage_rejects_by_certified_cutoffs(spark, tmp_path):
    folder = labelled(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rows = con.execute(f"SELECT doc_id, kept, base_failed FROM ({ORACLES['op4_quality_rules']})").fetchall()
    assert sum(not kept and not failed for _, kept, failed in rows) > 200
    got = P.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r.doc_id for r in got.collect()} == {i for i, kept, _ in rows if kept}


@pytest.mark.parametrize("i", range(len(P.STAGES)))
def test_stages_take_odd_tables(spark, folder, i):
    t = T.corpus()[-1]
    rows = [(1, t, "en", "s", 1, 9), (1, t, "en", "s", 1, 9), (None, "x " * 30, None, None, None, None), (2, None, "de", "s", 0, 1), (3, "", None, "s", 0, 1)]
    odd = spark.createDataFrame(rows, SCHEMA + ", key int")
    stage = P.STAGES[i][1]
    got = stage(spark, odd, folder).collect()
    assert stage(spark, odd.limit(0), folder).collect() == []
    if i == 4:
        packed_whole(got, odd.collect())
    else:
        assert collections.Counter(r.doc_id for r in got) == collections.Counter([[1, 1], [1, None, 2, 3], [1, None, 2, 3], [1, None, 2, 3]][i])
        assert {r.text for r in got if r.doc_id == 1} == {t} and all(not r.text for r in got if r.doc_id in (2, 3))
