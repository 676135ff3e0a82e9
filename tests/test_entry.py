"""The driver's contract: names, schemas, and results equal to SQL on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p1_found", "p3_found", "p5_found"} <= set(entry.queries())


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", ["q01_normalize_text", "q02_parse_number", "q07_dedupe_keep_last", "q10_features", "q11_quality_score", "q24_percent_rank", "q26_out_of_fold_means", "q31_tfidf", "q33_components", "q41_exploration", "q44_order_stability", "q51_evaluation", "p1_found", "p3_found"])
def test_like_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = Counter(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    theirs = con.execute("SELECT " + ", ".join(columns) + " FROM (" + entry.oracle_sql()[name] + ") q").fetchall()
    assert mine == Counter(tuple(_plain(float(v) if v.__class__.__name__ == "Decimal" else v) for v in r) for r in theirs)
