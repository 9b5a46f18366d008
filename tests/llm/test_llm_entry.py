"""The registered queries of the operators on small tables, against SQL where there is some."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from promptloom.llm.quality import quality_rules
from promptloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


def same(df, sql, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}'")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    rows, cols = df.collect(), sorted(df.columns)
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLES:
        same(df, ORACLES[name], SF)
    else:
        assert df.count() > 0


def labelled(spark, tmp_path):
    """A folder of documents in three strata with labels enough to certify a cutoff in each."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    signs = lambda n: "".join(" " + "".join(r.choice("#!|$") for _ in range(4)) for _ in range(n))
    rows, labels = [], []
    for i in range(2100):
        bad = i % 7 == 0
        text = " ".join(word() for _ in range(40)) + (signs(r.randint(24, 60)) if bad or r.random() < 0.004 else "")
        rows.append((i, text, ["en", "de", None][i % 3], "s", len(text)))
        labels.append((i, int(not bad), 0))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_certified_cutoffs_are_those_of_the_sql(spark, tmp_path):
    """The verdict does not hang on the base alone."""
    folder = labelled(spark, tmp_path)
    same(QUERIES["op4_quality_rules"](spark, folder), ORACLES["op4_quality_rules"], folder)
    judged = quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert {x.stratum for x in judged if x.cutoff is not None} == {"en", "de", ""}
    assert sum(not x.kept and not x.base_failed for x in judged) > 200
    good = [x for x in judged if x.doc_id % 7]
    assert sum(x.kept for x in good) >= 0.95 * len(good)
