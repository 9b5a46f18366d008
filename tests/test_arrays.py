"""Arrays in byte ranges against the standard library."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest

from promptloom.sources import prompts as intake
from promptloom.sources.arrays import structure


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def value(r, depth=0):
    kind = r.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(r.choice('ab{}[],:"\\é\n漢/ ') for _ in range(r.randrange(30)))
    if kind < 5:
        return r.choice([None, True, 7, -2.5, 1e20])
    if kind == 5:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}": value(r, depth + 1) for i in range(r.randrange(4))}


def elements(r, n):
    return [value(r) if r.random() < 0.1 else {"id": f"i{i}", "prompt": value(r) if r.random() < 0.3 else "".join(r.choice('xy{}\\",[]') for _ in range(r.randrange(300))), "more": value(r)} for i in range(n)]


def expected(file, items):
    out = []
    for i, x in enumerate(items):
        name = str(x["id"]) if isinstance(x, dict) and "id" in x else f"offset-{i}"
        prompt = x.get("prompt") if isinstance(x, dict) and isinstance(x.get("prompt"), str) else None
        out.append((file, i, name, prompt, None if prompt is not None else "invalid_input"))
    return out


def read(spark, path):
    return sorted((os.path.basename(r.file), r.seq, r.item_id, r.prompt, r.failure_class) for r in intake.read_prompt_array(spark, str(path)).collect())


def test_ranges_of_arrays(spark, tmp_path, small_splits):
    want = []
    for f in range(4):
        r = random.Random(f)
        items = elements(r, [400, 150, 3, 0][f])
        want += expected(f"{f}.json", items)
        (tmp_path / f"{f}.json").write_text(" \n" * f + json.dumps(items, indent=[None, 1, None, None][f], ensure_ascii=f % 2 == 0) + "\n" * f)
    (tmp_path / "4.json").write_text(json.dumps([{"id": "big", "prompt": "\\\"{[" * 5000}, {"id": 2, "prompt": ""}]))
    want += [("4.json", 0, "big", "\\\"{[" * 5000, None), ("4.json", 1, "2", "", None)]
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
    assert read(spark, tmp_path) == sorted(want)


def test_ids_and_keys_as_written(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1.0, "prompt": "a"}, {"id": 1e2, "prompt": "b"}, {"prompt": "x", "id": "q", "prompt": "y"}, {"id": null, "prompt": "c"}, {"id": true, "prompt": "d"}]')
    assert [(r[2], r[3]) for r in read(spark, tmp_path)] == [("1.0", "a"), ("1E+2", "b"), ("q", "y"), ("None", "c"), ("True", "d")]


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("text", ['[{"prompt": "a"},]', '[{"prompt": "a"} {"prompt": "b"}]', '[{"prompt": "a"}', '{"prompt": "a"}', '[1][2]', '[1] x', '[{"prompt": "a"]}', '[NaN]', '["a]', '[{"prompt": "a"}]}', "[,1]"])
def test_one_fault_fails_the_file(spark, tmp_path, text, split):
    if split:
        many = ", ".join('{"prompt": "%s"}' % ("x" * 50) for _ in range(400))
        text = text.replace("[", f"[{many}, ", 1) if text.startswith("[") else text + " " * 9000
        old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        (tmp_path / "a.json").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            read(spark, tmp_path)
    finally:
        if split:
            for k, v in old.items():
                spark.conf.set(k, v)


def test_structure_of_parts_is_that_of_the_whole():
    r = random.Random(1)
    for _ in range(200):
        raw = np.frombuffer(json.dumps(elements(r, 3)).encode(), np.uint8)
        at, deep, inside, escaped = structure(raw, 0, 0)
        assert (inside, escaped) == (0, 0) and deep[-1] == 0
        cuts = sorted(r.sample(range(len(raw)), min(len(raw), 6)))
        state, depth, found = (0, 0), 0, []
        for lo, hi in zip([0, *cuts], [*cuts, len(raw)], strict=True):
            a, d, *state = structure(raw[lo:hi], *state)
            found += list(zip((a + lo).tolist(), (d + depth).tolist(), strict=True))
            depth = found[-1][1] if found else 0
        assert found == list(zip(at.tolist(), deep.tolist(), strict=True))


def test_an_array_of_over_128_mib(spark, tmp_path):
    n, text = 18_000, "lorem \\\" {ipsum}, [dolor] " * 300
    with open(tmp_path / "a.json", "w") as f:
        f.write("[" + ",\n".join('{"id": %d, "prompt": "%s%d"}' % (i, text, i) for i in range(n)) + "]")
    assert os.path.getsize(tmp_path / "a.json") > 128 << 20
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(24 << 20))
    try:
        rows = intake.read_prompt_array(spark, str(tmp_path)).selectExpr("seq", "item_id", "length(prompt) AS n", "failure_class").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    size = len(text.replace("\\\"", '"'))
    assert len(rows) == n and {r.seq for r in rows} == set(range(n)) and all(r.failure_class is None and r.item_id == str(r.seq) and r.n == size + len(r.item_id) for r in rows)
