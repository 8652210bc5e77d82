"""The registered queries against their SQL, and the entry point without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from motionloom import catalog
from motionloom import schema as S

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    expected, found = con.sql(catalog.ORACLE_SQL[name]).df(), catalog.QUERIES[name](spark, data).toPandas()
    assert sorted(expected) == sorted(found)
    clean = lambda df: sorted(tuple("-" if x is None or x != x else x for x in r) for r in df[sorted(df)].astype(object).itertuples(index=False))
    key = lambda rows: sorted(rows, key=str)
    try:
        assert key(clean(found)) == key(clean(expected))
    except TypeError:
        plain = lambda df: sorted(str(tuple("-" if x is None or x != x else x for x in r)) for r in df[sorted(df)].astype(object).itertuples(index=False))
        assert plain(found) == plain(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['motionloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'window_histogram' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_evaluations_cover_all_methods_and_seeds(spark, data):
    rows = catalog.QUERIES["method_matrix"](spark, data).collect()
    assert sorted(r["method"] for r in rows) == sorted(S.METHODS) and {r["status"] for r in rows} == {"ok"}
    rows = catalog.QUERIES["seed_variance"](spark, data).collect()
    assert {(r["method"], r["seed"]) for r in rows} == {(m, s) for m in ("ap_sampled", "ap_coreset", "ap_kmeans", "ap_stratified") for s in range(1, 11)}
