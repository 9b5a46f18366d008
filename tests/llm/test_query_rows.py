"""Registered queries without SQL: every column against plain Python, on odd texts and one of several megabytes."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from promptloom.llm.queries import QUERIES


def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 6)))
    line = lambda k: " ".join(word() for _ in range(k))
    passage = line(40)
    out = [None, "", " \n\t", "one", "A B\x0bC\x0cD\rE", "ﬁ ① 😀 é", "<|endoftext|> x", "x" * 3000, "ab " * 400]
    out += ["\n".join(line(r.randint(1, 12)) for _ in range(r.randint(1, 6))) + (f" {passage}" if i % 4 == 0 else "") for i in range(30)]
    return [*out, out[-1], out[-2], line(3000), line(3000), "z" * 2_000_000]


TEXTS = texts()
IDS = [3 * i + 1 for i in range(len(TEXTS))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, ["en", None][i % 2], ["s0", "s0", "s1", None][i % 4], 5) for i, t in zip(IDS, TEXTS, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(spark, folder, name):
    return sorted(QUERIES[name](spark, folder).collect(), key=lambda r: r.doc_id)


def encoded(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def packed(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, folder):
    want = [(i, len((t or "").encode()), len(ids), len(ids) > 512) for i, t, ids in zip(IDS, TEXTS, encoded("byte_bpe_50k.json"), strict=True)]
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows_of(spark, folder, "op2_token_counts")] == want


def test_op3(spark, folder):
    seen, want = set(), []
    for i, t in zip(IDS, TEXTS, strict=True):
        raw = (t or "").encode()
        if raw[:200] == b"z" * 200:  # what one byte repeated brings is known, and slow to search
            want.append((i, len(raw), len(raw) - 1, 1, hashlib.sha256(b"z").hexdigest()))
            continue
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, folder, "op3_suffix_dedup")] == want


def test_op5(spark, folder):
    rows = rows_of(spark, folder, "op5_sharding")
    assert [(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows] == [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t in zip(IDS, TEXTS, strict=True)]
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6(spark, folder):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in zip(IDS, TEXTS, strict=True):
        ids = lib.encode(t or "")
        back = lib.decode(ids).encode()
        want.append((i, len(ids), packed(ids), len(back), zlib.crc32(back)))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32, r.n_bytes, r.text_crc32) for r in rows_of(spark, folder, "op6_sentencepiece")] == want


def test_op9(spark, folder):
    want, at = [], 0
    for i, ids in zip(IDS, encoded("word_bpe_49k.json"), strict=True):
        want.append((i, at, len(ids) + 1, packed([*ids, 2])))
        at += len(ids) + 1
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, folder, "op9_token_file")] == want


def test_op10(spark, folder):
    ids = {i: [*x, 1] for i, x in zip(IDS, encoded("word_bpe_49k.json"), strict=True)}
    rows = QUERIES["op10_packing"](spark, folder).collect()
    own, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == packed(ids[r.doc_id][r.start : r.start + r.length])
        own[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(own) == set(ids)
    for i, pieces in own.items():
        ends = np.cumsum([n for _, n in sorted(pieces)]).tolist()
        assert [s for s, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] == len(ids[i])
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)]).tolist()
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= sum(map(len, ids.values())) / 2048 * 1.02 + 2
