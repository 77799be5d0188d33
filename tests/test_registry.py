"""Queries whose result SQL can give too, on the smallest tables, where these are there."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from ledgerline.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["A08_npl_ratio_trend", "P24_financial_ratios", "J07_asof_join", "J08_interval_join", "A18_column_profile", "W16_cap_table_segments", "W20_composite_score", "C01_abt_pd", "C24_decision", "Q16_shares_sum_to_one", "G12_circular_payment_flag", "M07_roc_auc", "D16_best_fact", "A04_median_by", "M18_psi", "G14_pit_graph_features", "G17_ownership_depth", "G19_ego_subgraph", "D09_hybrid_search", "M35_decile_stratified_split", "S10_write_jdbc"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, name):
    query = registry()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = query.run(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(query.sql)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_every_query_has_a_name_of_its_item():
    assert len(registry()) > 250 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registration_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["Q14_address_checks", "G23_match_counterparties"])
def test_members_are_counted_as_rows(spark, capsys, name):
    registry()[name].run(spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert "Expand" not in plan and "distinct" not in plan
    test_against_sql(spark, name)
