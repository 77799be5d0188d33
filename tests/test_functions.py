"""Null, tie and boundary rules of expressions and sources."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline import functions as L
from ledgerline import sources
from ledgerline.functions import text as X
from ledgerline.operators import credit as K
from ledgerline.operators import rows as R
from ledgerline.operators import windows as V


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_money_ratios_and_bounds(spark):
    assert values(spark, [("$1,234,567.00 ",), ("",), ("text",), ("12.5",), (None,)], "x string", L.parse_money("x")) == [(1234567.0,), (None,), (None,), (12.5,), (None,)]
    assert values(spark, [(1.0, 0.0), (4.0, -2.0), (None, 1.0), (1e12, 1.0)], "a double, b double", L.safe_ratio("a", "b")) == [(None,), (-2.0,), (None,), (1e6,)]
    assert values(spark, [(None,), (-5.0,), (7.0,)], "a double", L.clip("a", 0.0, 5.0)) == [(None,), (0.0,), (5.0,)]


def test_dates(spark):
    days = [(dt.date(2025, 3, 1),), (dt.date(2024, 3, 15),), (dt.date(2026, 1, 31),)]
    assert values(spark, days, "d date", L.previous_month_end("d")) == [(dt.date(2025, 2, 28),), (dt.date(2024, 2, 29),), (dt.date(2025, 12, 31),)]
    assert values(spark, [("31-Dec-98",), ("01-Jan-05",), ("x",)], "s string", L.parse_date("s", "dd-MMM-yy")) == [(dt.date(1998, 12, 31),), (dt.date(2005, 1, 1),), (None,)]
    at = F.lit(dt.date(2024, 1, 31))
    rows = [(dt.date(2024, 1, 31), None), (dt.date(2024, 2, 1), None), (dt.date(2023, 1, 1), dt.date(2024, 1, 31)), (dt.date(2023, 1, 1), dt.date(2024, 2, 1))]
    assert values(spark, rows, "valid_from date, valid_to date", L.active_at(at)) == [(True,), (False,), (False,), (True,)]


def test_local_numbers(spark):
    cases = {"1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "(1.500)": -1500.0, "12,5": 12.5, "12.5": 12.5, "1.234": 1234.0, "22%": 0.22, "-7": -7.0, "Rp 18.500": 18500.0, "none": None}
    got = values(spark, [(k,) for k in cases], "s string", F.col("s"), L.parse_local_number("s"))
    assert dict(got) == cases


def test_names_and_addresses(spark):
    assert values(spark, [("Jl. Sudirman No.5",), ("JALAN SUDIRMAN, NOMOR 5",), (None,)], "a string", X.canonical_address("a")) == [("JL SUDIRMAN NO 5",), ("JL SUDIRMAN NO 5",), ("",)]
    assert values(spark, [("Dr. Budi A. Santoso, S.E., M.M.",)], "n string", X.name_tokens("n")) == [(["BUDI", "SANTOSO"],)]
    assert values(spark, [(["Cash", "18.500", "Total 5", "7"],)], "l array<string>", X.join_label_value("l")) == [(["Cash 18.500", "Total 5", "7"],)]


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 9.0), (5, 1.0)], "id int, x double")
    assert {r.id: r.r for r in V.average_rank(df, "x", "r").collect()} == {1: 2.5, 2: 2.5, 3: None, 4: 4.0, 5: 1.0}
    assert {r.id: r.p for r in V.percent_rank_first(df, "x", "id", "p").collect()} == {1: 0.5, 2: 0.75, 3: None, 4: 1.0, 5: 0.25}


def test_row_ids_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    ranged = df.withColumn("range", R.range_of(df, ["k"], 300))
    assert ranged.select("range").distinct().count() > 10
    numbered = R.add_row_id(df, "n", ["k"]).orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, 5001)) and [r.k for r in numbered] == sorted(r.k for r in numbered)


def test_cap_table_adds_up(spark):
    d = dt.date
    rows = [(1, 1, 1.0, d(2020, 1, 1), None), (2, 1, 1.0, d(2020, 6, 1), d(2021, 1, 1)), (3, 1, 1.0, d(2020, 6, 1), None), (4, 1, 2.0, d(2020, 3, 1), d(2020, 3, 1))]
    cap = V.cap_table(spark.createDataFrame(rows, "rel long, k long, w double, valid_from date, valid_to date"), "rel", "k", "w").collect()
    live = [r for r in cap if r.rel != 4]
    for start in {r.valid_from for r in live}:
        assert abs(sum(r.share for r in live if r.valid_from == start) - 1) < 1e-9
    assert [(r.valid_from, r.valid_to) for r in cap if r.rel == 4] == [(d(2020, 3, 1), d(2020, 3, 1))]


def test_censoring(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), d(2020, 6, 1)), (2, d(2020, 1, 1), None), (3, d(2020, 9, 1), None), (4, d(2020, 9, 1), d(2020, 10, 1)), (5, d(2020, 1, 1), d(2021, 2, 1))]
    got = spark.createDataFrame(rows, "id int, s date, e date").select("id", *[v.alias(n) for n, v in K.horizon_target("s", "e", 12, "2021-03-01").items()]).collect()
    assert {r.id: (r.y, r.y_censored) for r in got} == {1: (1, False), 2: (0, False), 3: (None, True), 4: (1, False), 5: (0, False)}


def test_policy_arithmetic(spark):
    rows = [(100.0, 12, 0.0), (100.0, 12, 0.12)]
    got = values(spark, rows, "p double, m int, r double", F.round(K.instalment("p", "m", "r"), 4), F.round(K.instalment("p", "m", "r", F.lit(True)), 4))
    assert got == [(8.3333, 0.0), (8.8849, 1.0)]
    assert values(spark, [(0.008,), (0.0081,), (1.0,), (1.1,)], "p double", K.grade_from_pd("p")) == [("AAA",), ("AA",), ("CCC",), (None,)]
    fails = K.covenant_fails("g", "t", "i", "d", "c")
    assert values(spark, [("BBB", 1.0, None, 2.0, None)], "g string, t double, i double, d double, c double", fails["violated"], fails["passed"]) == [(["icr"], False)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double")
    assert sources.write_table(df, str(tmp_path), "gold", "t") == 2
    assert sources.read_table(spark, str(tmp_path), "gold", "t", ["x"]).columns == ["x"]
    with pytest.raises(ValueError, match="missing: y"):
        sources.read_table(spark, str(tmp_path), "gold", "t", required=["y"])
    sources.write_csv(df, f"{tmp_path}/c")
    assert sources.read_csv(spark, f"{tmp_path}/c", "id long, x double", ["x"], 1).count() == 1
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    sources.write_vector_index(vectors, "v", "m1", f"{tmp_path}/i")
    assert {r.id: [round(x, 4) for x in r.v] for r in sources.read_vector_index(spark, f"{tmp_path}/i", "m1").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    with pytest.raises(ValueError, match="not of m2"):
        sources.read_vector_index(spark, f"{tmp_path}/i", "m2")
    assert sources.jdbc_options("jdbc:x", "t")["batchsize"] == "20000"
    (tmp_path / "g.jsonl").write_text('{"id": "a", "page": 1, "expected_raw_facts": {"k": "1"}}\n')
    assert sources.read_goldens(spark, f"{tmp_path}/g.jsonl").first().expected_raw_facts == {"k": "1"}
