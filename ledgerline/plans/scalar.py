"""Queries over scalar expressions and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import functions as L
from ledgerline import sources as S
from ledgerline.operators.graph import shared
from ledgerline.operators import rows as R
from ledgerline.plans import Register, Tables

query = Register()

#: Units of foreign currency in dollars, and the local currency in a dollar.
USD_PER = {"AUTOMOBILE": 1.17, "BUILDING": 0.15, "FURNITURE": 0.0063, "HOUSEHOLD": 1.36}
LOCAL_PER_USD = 17700.0
STATUS = {"F": "finished", "O": "open"}
SIZE_EDGES, SIZE_NAMES = (10, 25, 40), ("small", "medium", "large", "huge")
_USD_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in USD_PER.items()) + " ELSE 1.0 END"
#: order amounts as a statement's items: see statement()
_ITEMS = """items AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS assets, sum(l_extendedprice * l_tax * 10) AS liabilities,
 sum(l_quantity * 1000) AS current_assets, sum(l_quantity * l_discount * 10000) AS current_liabilities,
 sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.3 END) AS long_term_debt, sum(l_quantity * 100) AS inventory,
 sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * 0.1 END) AS receivables, sum(l_extendedprice * l_tax) AS retained,
 sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity * 900) AS cogs, sum(l_extendedprice * (1 - l_discount) - l_quantity * 900) AS gross_profit,
 sum(l_extendedprice * 0.1 - l_quantity * 100) AS ebit, sum(l_extendedprice * 0.12 - l_quantity * 100) AS ebitda,
 sum(l_extendedprice * 0.05 - l_quantity * 60) AS net_income, sum(l_extendedprice * 0.02) AS depreciation FROM lineitem GROUP BY l_orderkey)"""


def statement(t: Tables) -> DataFrame:
    """Lineitems of an order added up as if they were the items of a financial statement."""
    c, s = F.col, F.sum
    price, qty = c("l_extendedprice"), c("l_quantity")
    net = price * (1 - c("l_discount"))
    return t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(
        s(price).alias("assets"), s(price * c("l_tax") * 10).alias("liabilities"), s(qty * 1000).alias("current_assets"),
        s(qty * c("l_discount") * 10000).alias("current_liabilities"), s(F.when(c("l_returnflag") == "R", price * 0.3)).alias("long_term_debt"),
        s(qty * 100).alias("inventory"), s(F.when(c("l_linestatus") == "O", price * 0.1)).alias("receivables"), s(price * c("l_tax")).alias("retained"),
        s(net).alias("revenue"), s(qty * 900).alias("cogs"), s(net - qty * 900).alias("gross_profit"), s(price * 0.1 - qty * 100).alias("ebit"),
        s(price * 0.12 - qty * 100).alias("ebitda"), s(price * 0.05 - qty * 60).alias("net_income"), s(price * 0.02).alias("depreciation"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def S01_scan_csv(t: Tables) -> DataFrame:
    """A scan with chosen columns and a cap on rows, which is the feature."""
    return R.scan(t.orders, ["o_orderkey", "o_totalprice"], 50, "o_orderkey")


@query("SELECT o_orderkey AS application_id, o_custkey AS borrower_id, 'orders' AS origin FROM orders")
def S02_scan_renamed(t: Tables) -> DataFrame:
    return R.renamed(t.orders, {"o_orderkey": "application_id", "o_custkey": "borrower_id", "missing": "nothing"}, "orders")[0]


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id, o_orderkey FROM orders")
def S03_add_row_id(t: Tables) -> DataFrame:
    return R.add_row_id(t.orders, "row_id", ["o_orderdate", "o_orderkey"]).select("row_id", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice AS amount, CAST(o_orderdate AS DATE)::VARCHAR AS day, upper(trim(o_orderpriority)) AS priority, lpad(o_orderkey::VARCHAR, greatest(8, length(o_orderkey::VARCHAR))::INTEGER, '0') AS padded FROM orders")
def S04_scan_cleaned(t: Tables) -> DataFrame:
    raw = t.orders.select("o_orderkey", F.format_string("$%,.2f ", "o_totalprice").alias("amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), "o_orderpriority")
    return raw.select("o_orderkey", L.parse_money("amount").alias("amount"), L.parse_date("day", "dd/MM/yyyy").cast("string").alias("day"), L.clean("o_orderpriority").alias("priority"), L.clean(F.col("o_orderkey").cast("string"), zero_pad=8).alias("padded"))


@query("SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def S05_scan_edges_filtered(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_suppkey", "l_returnflag")


@query("SELECT c_custkey, c_acctbal FROM customer")
def S06_read_table(t: Tables) -> DataFrame:
    return R.require(t.customer, ["c_custkey", "c_acctbal"]).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders")
def P01_parse_money(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", L.parse_money(F.format_string(" $%,.2f ", "o_totalprice")).alias("amount"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN round(greatest(-1e6, least(1e6, l_extendedprice / l_tax)), 4) END AS ratio FROM lineitem")
def P02_safe_ratio(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(L.safe_ratio("l_extendedprice", "l_tax"), 4).alias("ratio"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS d1, CAST(o_orderdate AS DATE)::VARCHAR AS d2 FROM orders")
def P03_parse_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", L.parse_date(F.date_format("o_orderdate", "dd-MMM-yy"), "dd-MMM-yy").cast("string").alias("d1"), L.parse_date(F.date_format("o_orderdate", "yyyy/MM/dd"), "yyyy/MM/dd").cast("string").alias("d2"))


@query("SELECT p_partkey, upper(trim(p_name)) AS upper_name, lower(trim(p_brand)) AS lower_brand, CASE WHEN length(p_size::VARCHAR) < 4 THEN lpad(p_size::VARCHAR, 4, '0') ELSE p_size::VARCHAR END AS padded FROM part")
def P04_clean_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.clean("p_name").alias("upper_name"), L.clean("p_brand", "lower").alias("lower_brand"), L.clean(F.col("p_size").cast("string"), zero_pad=4).alias("padded"))


@query("SELECT o_orderkey, last_day(o_orderdate)::VARCHAR AS month_end FROM orders")
def P05_month_end(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", L.month_end("o_orderdate").cast("string").alias("month_end"))


@query("SELECT o_orderkey, (date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE::VARCHAR AS known_until FROM orders")
def P06_previous_month_end(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", L.previous_month_end("o_orderdate").cast("string").alias("known_until"))


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) AS n FROM orders GROUP BY 1")
def P07_month_bucket(t: Tables) -> DataFrame:
    return t.orders.groupBy(L.month_bucket("o_orderdate").cast("string").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 12 MONTH)::DATE::VARCHAR AS horizon FROM orders")
def P08_horizon_end(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.add_months("o_orderdate", 12).cast("string").alias("horizon"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def P09_days_between(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", L.days_between("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("""WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
SELECT event_id, 1609459200 + CAST(floor((epoch_us(ts) - lo) / (hi - lo)::DOUBLE * 86400 * 365) AS BIGINT) AS stretched FROM events, b""")
def P10_rescale_time(t: Tables) -> DataFrame:
    """The seconds of the observed range on a year from 2021-01-01 on; the bounds are one row."""
    return R.rescale(t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "us", "stretched", 1609459200, 86400 * 365).select("event_id", "stretched")


@query("SELECT o_orderkey, o_orderstatus AS src_status, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
def P11_map_lookup(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("src_status"), L.map_lookup("o_orderstatus", STATUS, "other").alias("status"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'round' WHEN contains(lower(p_name), 'red') THEN 'red' ELSE 'other' END AS kind FROM part")
def P12_classify_by_substring(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.classify("p_name", [("round", ["ring", "gear"]), ("red", ["red"])], "other").alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'medium' WHEN p_size <= 40 THEN 'large' ELSE 'huge' END AS band FROM part")
def P13_bin_fixed(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.bin_fixed("p_size", SIZE_EDGES, SIZE_NAMES).alias("band"))


@query("SELECT c_custkey, least(5000.0, greatest(0.0, c_acctbal)) AS bounded FROM customer")
def P14_clip(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", L.clip("c_acctbal", 0.0, 5000.0).alias("bounded"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS known, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS level FROM orders")
def P15_select_case(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", p).alias("known"), F.when(p > 400000, "high").when(p > 100000, "middle").otherwise("low").alias("level"))


@query("SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 8) AS weight FROM customer")
def P16_log_weight(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(L.log_weight("c_acctbal"), 8).alias("weight"))


@query("SELECT c_custkey, c_acctbal AS fin_c_acctbal, c_nationkey AS fin_c_nationkey FROM customer")
def P17_prefix_block(t: Tables) -> DataFrame:
    return R.prefix_block(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), "fin_", ["c_custkey"])


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS app_day, o_totalprice AS app_amount FROM orders")
def P18_select_block(t: Tables) -> DataFrame:
    wide = t.orders.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("app_day"), F.col("o_totalprice").alias("app_amount"), F.col("o_orderstatus").alias("y_default"))
    return R.select_block(wide, keep=["o_orderkey"], prefixes=["app_"], forbidden=["y_default"])


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 END::BIGINT AS grade FROM orders")
def P19_ordinal_rating(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", L.ordinal("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]).cast("long").alias("grade"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - l_extendedprice * (1 - l_discount)) / nullif(l_extendedprice, 0), 6) AS gap FROM lineitem")
def P20_reconciliation_gap(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(L.reconciliation_gap("l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount"))), 6).alias("gap"))


@query("SELECT p_partkey, p_type || '-' || p_size::VARCHAR || '-' || p_brand AS key FROM part")
def P21_composite_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.composite_key("p_type", "p_size", "p_brand").alias("key"))


@query("SELECT c_custkey, 'CIF-' || lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INTEGER, '0') AS cif FROM customer")
def P22_format_id(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", L.format_id("CIF", "c_custkey").alias("cif"))


@query(f"WITH {_ITEMS} SELECT k, round(nullif(greatest(ebit - net_income / 0.78, 0.01 * greatest(liabilities, 0)), 0), 6) AS interest FROM items")
def P23_derive_interest(t: Tables) -> DataFrame:
    return statement(t).select("k", F.round(L.derive_interest("ebit", "net_income", "liabilities"), 6).alias("interest"))


def _r(num: str, den: str, scale: str = "") -> str:
    return f"CASE WHEN ({den}) <> 0 AND ({num}) IS NOT NULL THEN least(1e6, greatest(-1e6, ({num}) / ({den}))) END{scale}"


_I = "greatest(ebit - net_income / 0.78, 0.01 * greatest(liabilities, 0))"
_POS = "CASE WHEN assets - liabilities > 0 THEN assets - liabilities END"
_EB = "CASE WHEN ebitda > 0 THEN ebitda END"
_RATIOS = {
    "equity": "assets - liabilities", "der_total": _r("liabilities", _POS), "der_interest": _r("long_term_debt", _POS), "debt_to_ebitda": _r("long_term_debt + current_liabilities", _EB),
    "icr_ebit": _r("ebit", _I), "icr_ebitda": _r("ebitda", _I), "roa": _r("net_income", "assets"), "operating_margin": _r("ebit", "revenue"), "gross_margin": _r("gross_profit", "revenue"),
    "current_ratio": _r("current_assets", "current_liabilities"), "quick_ratio": _r("current_assets - inventory", "current_liabilities"), "asset_turnover": _r("revenue", "assets"),
    "wc_to_ta": _r("current_assets - current_liabilities", "assets"), "re_to_ta": _r("retained", "assets"), "cfo_to_ebitda": _r("net_income + depreciation", _EB),
    "dso_days": _r("receivables", "revenue", " * 365"), "dio_days": _r("inventory", "cogs", " * 365"),
    "cycle_days": f"CASE WHEN ({_r('receivables', 'revenue')} + {_r('inventory', 'cogs')}) IS NOT NULL THEN greatest(0, least(720, {_r('receivables', 'revenue', ' * 365')} + {_r('inventory', 'cogs', ' * 365')})) END",
}


@query(f"WITH {_ITEMS} SELECT k, " + ", ".join(f"round({v}, 7) AS {k}" for k, v in _RATIOS.items()) + " FROM items")
def P24_financial_ratios(t: Tables) -> DataFrame:
    return statement(t).select("k", *[F.round(c, 7).alias(n) for n, c in L.financial_ratios().items()])


@query("SELECT o_orderkey, o_totalprice AS english, o_totalprice AS local, -o_totalprice AS negative, round(o_totalprice / 100, 6) AS share FROM orders")
def P25_parse_local_number(t: Tables) -> DataFrame:
    shown = F.format_string("%,.2f", "o_totalprice")
    local = F.translate(shown, ",.", ".,")
    return t.orders.select("o_orderkey", L.parse_local_number(shown).alias("english"), L.parse_local_number(F.concat(F.lit("Rp "), local)).alias("local"), L.parse_local_number(F.concat(F.lit("("), local, F.lit(")"))).alias("negative"), F.round(L.parse_local_number(F.concat(local, F.lit("%"))), 6).alias("share"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders")
def P26_null_sentinels(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "P", " N/A ").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", L.null_sentinels(raw).alias("status"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '[' || CAST(json_extract(props, '$.k') AS INTEGER)::VARCHAR || ',' || (event_id % 7)::VARCHAR || ']' AS pages FROM events")
def P27_page_json(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    pages = F.to_json(F.array(k, (F.col("event_id") % 7).cast("int")))
    return t.events.select("event_id", F.from_json(pages, "array<int>")[0].alias("k"), pages.alias("pages"))


@query(f"WITH {_ITEMS} SELECT k, round(CASE WHEN net_income IS NOT NULL AND (long_term_debt IS NOT NULL OR receivables IS NOT NULL) THEN net_income + coalesce(long_term_debt, 0) + coalesce(receivables, 0) END, 5) AS rebuilt FROM items")
def P28_rebuild_ebitda(t: Tables) -> DataFrame:
    return statement(t).select("k", F.round(L.rebuild_ebitda("net_income", "long_term_debt", "receivables"), 5).alias("rebuilt"))


@query(f"SELECT c_custkey, round(c_acctbal * ({_USD_SQL}) * 17700.0, 2) AS local_amount FROM customer")
def P29_convert_currency(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(L.convert("c_acctbal", "c_mktsegment", USD_PER, LOCAL_PER_USD), 2).alias("local_amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '2019-01-01' ELSE o_orderdate::DATE::VARCHAR END AS valid_from FROM orders")
def P30_default_date(t: Tables) -> DataFrame:
    start = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", F.coalesce(start, F.lit("2019-01-01").cast("date")).cast("string").alias("valid_from"))


@query(f"""WITH {_ITEMS} SELECT k, round(coalesce({_r('long_term_debt', 'assets')}, 0.15), 6) AS leverage, round(coalesce({_r('receivables', 'revenue')}, 0.05), 6) AS receivable_share,
 concat_ws(',', CASE WHEN ({_r('long_term_debt', 'assets')}) IS NULL THEN 'leverage' END, CASE WHEN ({_r('receivables', 'revenue')}) IS NULL THEN 'receivable_share' END) AS filled FROM items""")
def P31_row_features(t: Tables) -> DataFrame:
    ratios = {"leverage": L.safe_ratio("long_term_debt", "assets"), "receivable_share": L.safe_ratio("receivables", "revenue")}
    filled, names = R.filled_from({"leverage": 0.15, "receivable_share": 0.05}, ratios)
    return statement(t).select("k", *[F.round(c, 6).alias(n) for n, c in filled.items()], F.array_join(names, ",").alias("filled"))


def _scratch(t: Tables, name: str) -> str:
    """A new path in the folder that the session shares."""
    return f"{shared(t.spark)}/tables/{uuid.uuid4().hex}-{name}"


@query("SELECT c_custkey, c_acctbal FROM customer")
def S07_write_table(t: Tables) -> DataFrame:
    root = _scratch(t, "gold")
    S.write_table(t.customer.select("c_custkey", "c_acctbal"), root, "gold", "balances")
    return S.read_table(t.spark, root, "gold", "balances", ["c_custkey", "c_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS nation, c_acctbal FROM customer")
def S10_write_jdbc(t: Tables) -> DataFrame:
    """A round trip over JDBC in batches; whole numbers stay whole where there are nulls.

    The database is the one that Spark ships, in the memory of this process, so this query is for local sessions; the
    writer takes any URL.
    """
    options = S.jdbc_options(f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", "BALANCES", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    rows = t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("nation"), "c_acctbal")
    S.write_jdbc(rows, options)
    return S.read_jdbc(t.spark, options)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def S11_write_csv(t: Tables) -> DataFrame:
    path = _scratch(t, "csv")
    S.write_csv(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return S.read_csv(t.spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("SELECT item_id::VARCHAR AS id, text AS page_text FROM benchmark")
def S13_read_goldens(t: Tables) -> DataFrame:
    path = _scratch(t, "jsonl")
    t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("page_text")).write.json(path)
    return S.read_goldens(t.spark, path).select("id", "page_text")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 3) > 0 AS unit FROM embeddings")
def S14_vector_index(t: Tables) -> DataFrame:
    path = _scratch(t, "index")
    S.write_vector_index(t.embeddings.select("vec_id", "embedding"), "embedding", "m1", path)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return S.read_vector_index(t.spark, path, "m1").select("vec_id", (F.abs(size - 1) < 1e-3).alias("unit"))
