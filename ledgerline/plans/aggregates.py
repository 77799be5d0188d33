"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import functions as L
from ledgerline.operators import aggregates as A
from ledgerline.operators import quantiles as Q
from ledgerline.plans import Register, Tables
from ledgerline.plans.relational import _FIRST, _INTERVALS, first_events, intervals

query = Register()
c = F.col


def payments(t: Tables) -> DataFrame:
    """Customer to supplier, as payments."""
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("src"), c("l_suppkey").alias("dst"), c("l_extendedprice").alias("amount"), c("l_shipdate").alias("paid"))


_PAY = "pay AS (SELECT o_custkey AS src, l_suppkey AS dst, l_extendedprice AS amount, l_shipdate AS paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_PAY} SELECT src, dst, round(sum(amount), 2) AS total, min(paid)::DATE::VARCHAR AS since, count(*) AS n FROM pay GROUP BY 1, 2")
def A01_edge_aggregate(t: Tables) -> DataFrame:
    return payments(t).groupBy("src", "dst").agg(F.round(F.sum("amount"), 2).alias("total"), F.to_date(F.min("paid")).cast("string").alias("since"), F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS value, max(l_tax) AS ratio, bool_or(l_returnflag = 'R') AS any_returned, bool_or(l_linestatus = 'O') AS any_open FROM lineitem GROUP BY 1")
def A02_collateral_summary(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"), F.max("l_tax").alias("ratio"), F.bool_or(c("l_returnflag") == "R").alias("any_returned"), F.bool_or(c("l_linestatus") == "O").alias("any_open"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS members FROM lineitem GROUP BY 1")
def A03_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("members"))


@query("SELECT p_type, p_brand, round(median(p_retailprice), 6) AS p_retailprice, round(median(p_size), 6) AS p_size, count(*) AS n FROM part GROUP BY 1, 2")
def A04_median_by(t: Tables) -> DataFrame:
    return Q.medians(t.part, ["p_retailprice", "p_size"], ["p_type", "p_brand"]).join(t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n")), ["p_type", "p_brand"])


@query("SELECT o_orderstatus, round(median(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS urgent, round(median(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 2) AS high FROM orders GROUP BY 1")
def A05_pivot_median(t: Tables) -> DataFrame:
    own = lambda priority: F.when(c("o_orderpriority") == priority, c("o_totalprice"))
    return Q.medians(t.orders, {"urgent": own("1-URGENT"), "high": own("2-HIGH")}, ["o_orderstatus"], 2)


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.95) / 1000) * 1000 AS p95 FROM orders GROUP BY 1")
def A06_quantile_by(t: Tables) -> DataFrame:
    return Q.quantiles(t.orders, ["o_totalprice"], [0.95], ["o_orderpriority"]).select("o_orderpriority", (F.round(c("q")[0] / 1000) * 1000).alias("p95"))


@query("WITH m AS (SELECT o_orderpriority AS level, max(o_totalprice) AS top FROM orders GROUP BY 1) SELECT level, top, row_number() OVER (ORDER BY top, level) AS place, row_number() OVER (ORDER BY top, level) = count(*) OVER () AS open_ended FROM m")
def A07_authority_thresholds(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    tops = t.orders.groupBy(c("o_orderpriority").alias("level")).agg(F.max("o_totalprice").alias("top"))
    place = F.row_number().over(W.orderBy("top", "level")).cast("long")  # one row a level
    return tops.withColumn("place", place).withColumn("open_ended", c("place") == F.count("*").over(W.partitionBy()))


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0), 6) AS npl, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1")
def A08_npl_ratio_trend(t: Tables) -> DataFrame:
    """The share of each month's amounts that is in open orders."""
    return t.orders.groupBy(L.month_bucket("o_orderdate").cast("string").alias("month")).agg(F.round(A.share_where(c("o_orderstatus") == "O", c("o_totalprice")), 6).alias("npl"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("month")


@query(f"WITH {_INTERVALS} SELECT count(*) AS live, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0), 6) AS npl FROM iv JOIN orders USING (o_orderkey) WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')")
def A08_npl_ratio_at(t: Tables) -> DataFrame:
    live = intervals(t).where(L.active_at(F.lit("1998-06-30").cast("date"))).select("o_orderkey").join(t.orders, "o_orderkey")
    return live.agg(F.count("*").alias("live"), F.round(A.share_where(c("o_orderstatus") == "O", c("o_totalprice")), 6).alias("npl"))


@query("SELECT node, coalesce(n, 0) AS degree FROM (SELECT s_suppkey AS node FROM supplier) LEFT JOIN (SELECT x, count(*) AS n FROM (SELECT l_suppkey AS x FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY 1) ON x = node")
def A09_degree_counts(t: Tables) -> DataFrame:
    return A.degrees(t.lineitem, "l_suppkey", "l_partkey", t.supplier.select(c("s_suppkey").alias("node")))


@query("""WITH d AS (SELECT x, count(*) AS n FROM (SELECT l_suppkey AS x FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY 1 ORDER BY n DESC, x LIMIT 50)
SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT x FROM d) AND l_partkey IN (SELECT x FROM d) GROUP BY 1, 2""")
def A10_top_degree_subgraph(t: Tables) -> DataFrame:
    edges = A.top_degree_subgraph(t.lineitem.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", 50)
    return edges.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))


@query(f"WITH {_PAY}, w AS (SELECT src, dst, sum(amount) AS w FROM pay GROUP BY 1, 2) SELECT src, round(CASE WHEN sum(w) > 0 THEN sum(w * w) / (sum(w) * sum(w)) END, 8) AS hhi FROM w GROUP BY 1")
def A11_hhi(t: Tables) -> DataFrame:
    return payments(t).groupBy("src", "dst").agg(F.sum("amount").alias("w")).groupBy("src").agg(F.round(A.hhi("w"), 8).alias("hhi"))


@query("SELECT c_nationkey AS grp, last_day(o_orderdate)::VARCHAR AS month, round(sum(o_totalprice), 2) AS exposure, round(sum(o_totalprice) / 5e6, 8) AS share, round(5e6 - sum(o_totalprice), 2) AS room FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def A12_group_exposure(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy(c("c_nationkey").alias("grp"), F.last_day("o_orderdate").cast("string").alias("month")).agg(F.sum("o_totalprice").alias("s"))
    return rows.select("grp", "month", F.round("s", 2).alias("exposure"), F.round(c("s") / 5e6, 8).alias("share"), F.round(5e6 - c("s"), 2).alias("room"))


@query("SELECT l_orderkey, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS breached, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS tax_rate FROM lineitem GROUP BY 1")
def A13_breach_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(c("l_discount") > 0.05).alias("breached"), F.round(A.share_where(c("l_tax") > 0.04), 6).alias("tax_rate"))


@query("WITH r AS (SELECT l_partkey, l_suppkey, (row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1) // 1000 AS part FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) SELECT l_partkey, part, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS members FROM r GROUP BY 1, 2")
def A14_collect_members(t: Tables) -> DataFrame:
    """Members in lists of at most a thousand, so that a group of many is several rows."""
    return A.member_lists(t.lineitem, "l_partkey", "l_suppkey", 1000)


@query("SELECT round(median(p_retailprice), 6) AS p_retailprice, round(median(p_size), 6) AS p_size, (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1) AS p_type FROM part")
def A15_reference_values(t: Tables) -> DataFrame:
    return Q.medians(t.part, ["p_retailprice", "p_size"], []).crossJoin(t.part.agg(F.mode("p_type", deterministic=True).alias("p_type")))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def A16_last_per_key(t: Tables) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("last_order"), F.max_by("o_orderstatus", order).alias("status"))


@query("""SELECT conv_id, arg_min(CASE WHEN role = 'system' THEN length(text) END, CASE WHEN role = 'system' THEN turn END) AS system_chars, arg_min(CASE WHEN role = 'assistant' THEN length(text) END, CASE WHEN role = 'assistant' THEN turn END) AS first_answer, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def A17_first_non_null_merge(t: Tables) -> DataFrame:
    chars = F.length("text").cast("long")
    rows = t.conversations.withColumns({"system_chars": F.when(c("role") == "system", chars), "first_answer": F.when(c("role") == "assistant", chars)})
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return rows.groupBy("conv_id").agg(*A.first_non_null(["system_chars", "first_answer"], "turn"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), listed.alias("roles"))


def _profile_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS name, lower(typeof(any_value({c}))) AS kind, (SELECT round({c}::DOUBLE, 4) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS sample, count({c}) AS n, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS nulls, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 4) AS zeros, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS low, round(max({c})::DOUBLE, 4) AS high, " + ", ".join(f"round(quantile_cont({{c}}, {p})::DOUBLE, 4) AS {n}" for n, p in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))) + " FROM {t}"
    return " UNION ALL ".join(one.replace("{c}", x).replace("{t}", table) for x in columns)


@query(_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def A18_column_profile(t: Tables) -> DataFrame:
    return A.profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], 4)


@query("WITH e AS (SELECT CASE WHEN event_type = 'error' THEN value END AS a, CASE WHEN event_type IN ('error', 'view') THEN value END AS b, value AS c FROM events) SELECT * FROM (SELECT 'a' AS name, count(*) - count(a) AS nulls, round((count(*) - count(a)) / count(*) * 100, 4) AS percent FROM e UNION ALL SELECT 'b', count(*) - count(b), round((count(*) - count(b)) / count(*) * 100, 4) FROM e UNION ALL SELECT 'c', count(*) - count(c), round((count(*) - count(c)) / count(*) * 100, 4) FROM e) ORDER BY nulls DESC, name LIMIT 2")
def A19_missing_profile(t: Tables) -> DataFrame:
    v = c("value")
    return A.missing(t.events.select(F.when(c("event_type") == "error", v).alias("a"), F.when(c("event_type").isin("error", "view"), v).alias("b"), v.alias("c")), 2)


def labelled_orders(t: Tables) -> DataFrame:
    """Orders with a target: 1 in status F, 0 in O, null (censored) in P."""
    y = F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 0)
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).withColumn("y", y)


_LABELLED = "lab AS (SELECT o.*, c.*, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM orders o JOIN customer c ON o_custkey = c_custkey)"
_RATES = "count(*) AS rows, count(y) AS labelled, coalesce(sum(y), 0)::BIGINT AS events, round(avg(y), 6) AS rate, count(*) - count(y) AS censored"


@query(f"WITH {_LABELLED} SELECT c_mktsegment, o_orderpriority, {_RATES} FROM lab GROUP BY 1, 2")
def A20_bad_rate_table(t: Tables) -> DataFrame:
    return A.bad_rates(labelled_orders(t), ["c_mktsegment", "o_orderpriority"], "y")


@query(f"WITH {_LABELLED}, {_FIRST} SELECT ev.k IS NOT NULL AND event_at < o_orderdate AS signal, {_RATES} FROM lab LEFT JOIN ev ON ev.k = o_custkey GROUP BY 1")
def A21_signal_split(t: Tables) -> DataFrame:
    rows = labelled_orders(t).join(first_events(t), c("k") == c("o_custkey"), "left").withColumn("signal", c("k").isNotNull() & (c("event_at") < F.to_date("o_orderdate")))
    return A.bad_rates(rows, ["signal"], "y")


@query("WITH b AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer WHERE c_acctbal > 0) SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'zero' WHEN c_acctbal <= q[1] THEN 'Q1' WHEN c_acctbal <= q[2] THEN 'Q2' WHEN c_acctbal <= q[3] THEN 'Q3' ELSE 'Q4' END AS bucket FROM customer, b")
def A22_positive_quartiles(t: Tables) -> DataFrame:
    return A.positive_quartiles(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "bucket")


@query("SELECT c_mktsegment, round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END), 6) AS approved FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def A23_approval_rate(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy("c_mktsegment").agg(F.round(A.share_where(c("o_orderstatus") != "P"), 6).alias("approved"))


@query("SELECT l_partkey, count(DISTINCT c_nationkey) AS groups FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def A24_having_cross_group(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    return rows.groupBy("l_partkey").agg(F.countDistinct("c_nationkey").alias("groups")).where("groups > 1")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def A25_value_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS applications, round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END), 6) AS approved, round(sum(o_totalprice), 2) AS limits, round(sum(o_totalprice * CASE o_orderstatus WHEN 'O' THEN 0.05 ELSE 0.01 END), 2) AS expected_loss FROM orders")
def A26_portfolio_kpis(t: Tables) -> DataFrame:
    loss = c("o_totalprice") * F.when(c("o_orderstatus") == "O", 0.05).otherwise(0.01)
    return t.orders.agg(F.count("*").alias("applications"), F.round(A.share_where(c("o_orderstatus") != "P"), 6).alias("approved"), F.round(F.sum("o_totalprice"), 2).alias("limits"), F.round(F.sum(loss), 2).alias("expected_loss"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def A27_monthly_decisions(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, o_orderstatus, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice * c_acctbal) / nullif(sum(o_totalprice), 0), 4) AS balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def A28_composition(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    return rows.rollup("c_mktsegment", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(A.weighted_mean(c("c_acctbal"), c("o_totalprice")), 4).alias("balance"))


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def A29_facility_mix(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT round(CASE WHEN count(CASE WHEN l_quantity > 5 AND l_quantity < 40 THEN 1 END) > 100 THEN median(CASE WHEN l_quantity > 5 AND l_quantity < 40 THEN l_quantity END) ELSE 9 END, 4) AS quantity, round(CASE WHEN count(CASE WHEN l_tax > 5 THEN 1 END) > 100 THEN median(CASE WHEN l_tax > 5 THEN l_tax END) ELSE 0.25 END, 4) AS tax FROM lineitem")
def A30_trimmed_medians(t: Tables) -> DataFrame:
    q, x = c("l_quantity"), c("l_tax")
    found = A.trimmed_medians(t.lineitem, {"quantity": q, "tax": x}, {"quantity": (q > 5) & (q < 40), "tax": x > 5}, {"quantity": 9.0, "tax": 0.25}, 100)
    return found.select(F.round("quantity", 4).alias("quantity"), F.round("tax", 4).alias("tax"))


@query(f"WITH {_INTERVALS} SELECT o_custkey, count(*) AS live, round(sum(o_totalprice), 2) AS exposure FROM iv JOIN orders USING (o_orderkey, o_custkey) WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30') GROUP BY 1")
def A31_live_exposure(t: Tables) -> DataFrame:
    live = intervals(t).where(L.active_at(F.lit("1998-06-30").cast("date"))).select("o_orderkey").join(t.orders, "o_orderkey")
    return live.groupBy("o_custkey").agg(F.count("*").alias("live"), F.round(F.sum("o_totalprice"), 2).alias("exposure"))


@query("SELECT party, count(DISTINCT borrower) AS borrowers FROM (SELECT l_suppkey AS party, o_custkey AS borrower FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < DATE '1998-06-30' UNION SELECT l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < DATE '1997-06-30') GROUP BY 1")
def A32_party_degree(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    one = rows.where(c("l_shipdate") < F.lit("1998-06-30").cast("date")).select(c("l_suppkey").alias("party"), c("o_custkey").alias("borrower"))
    two = rows.where(c("l_shipdate") < F.lit("1997-06-30").cast("date")).select("l_partkey", "o_custkey")
    return one.union(two).distinct().groupBy("party").agg(F.countDistinct("borrower").alias("borrowers"))


@query("SELECT round(sum(abs(l_discount - 0.05) * l_extendedprice) / sum(l_extendedprice), 8) AS error FROM lineitem")
def A33_weighted_mean(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(A.weighted_mean(F.abs(c("l_discount") - 0.05), c("l_extendedprice")), 8).alias("error"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(abs(l_discount - 0.05)), 8) AS mae, round(sqrt(avg((l_discount - 0.05) * (l_discount - 0.05))), 8) AS rmse FROM lineitem GROUP BY 1")
def A34_segment_performance(t: Tables) -> DataFrame:
    e = c("l_discount") - 0.05
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 8).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"))


_WORST = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("WITH f AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1) SELECT o_orderpriority, round(share, 8) AS share, round(sum(share) OVER (ORDER BY o_orderpriority), 8) AS cumulative FROM f")
def A35_frequency_distribution(t: Tables) -> DataFrame:
    return A.frequencies(t.orders, "o_orderpriority", _WORST).select("o_orderpriority", F.round("share", 8).alias("share"), F.round("cumulative", 8).alias("cumulative"))


@query("SELECT c_nationkey, count(DISTINCT c_custkey) AS entities, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def A36_group_summary(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("entities"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT kind, round(coalesce(v, d), 8) AS v FROM (VALUES ('A', 0.1), ('N', 0.2), ('X', 0.3)) b(kind, d) FULL JOIN (SELECT l_returnflag AS kind, avg(l_discount) AS v FROM lineitem GROUP BY 1) USING (kind)")
def A37_recovery_by_type(t: Tables) -> DataFrame:
    means = t.lineitem.groupBy(c("l_returnflag").alias("kind")).agg(F.avg("l_discount").alias("v"))
    return A.with_defaults(means, "kind", "v", {"A": 0.1, "N": 0.2, "X": 0.3}).select("kind", F.round("v", 8).alias("v"))


@query("SELECT kind, round(coalesce(v, d), 4) AS v FROM (VALUES ('5-LOW', 1.0), ('9-NONE', 2.0)) b(kind, d) FULL JOIN (SELECT o_orderpriority AS kind, median(o_totalprice) AS v FROM orders GROUP BY 1) USING (kind)")
def A38_median_price_by_band(t: Tables) -> DataFrame:
    rows = Q.medians(t.orders.withColumnRenamed("o_orderpriority", "kind"), {"v": "o_totalprice"}, ["kind"], None)
    return A.with_defaults(rows, "kind", "v", {"5-LOW": 1.0, "9-NONE": 2.0}).select("kind", F.round("v", 4).alias("v"))


@query(_profile_sql("events", ["value"]))
def A39_describe(t: Tables) -> DataFrame:
    return A.profile(t.events, ["value"], 4)


@query("WITH b AS (SELECT quantile_cont(value, [0.01, 0.99]) AS q FROM events) SELECT greatest(0, least(19, floor((value - q[1]) / (q[2] - q[1]) * 20)))::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1")
def A40_histogram(t: Tables) -> DataFrame:
    return A.histogram(t.events, "value", 20)
