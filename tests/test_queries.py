"""A few queries against their SQL, and the entry without the corpus operators."""

import subprocess
import sys

import duckdb
import pytest

from tiergraph import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
QUICK = ["sel_combined", "inspect_edges", "reach_depth2", "shortest_path", "val_l1_gdm_03", "val_l1_eid_05", "val_l2_gdm_01", "merge_nodes", "diff_props", "redact_hash", "canonical_ids"]


def same(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(Q.ORACLES[name]).df()
    rows = lambda df: sorted(repr([None if v is None or v != v else v for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got) == rows(want)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    assert same(spark, name)


def test_entry_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['tiergraph.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
