"""Queries over filters, joins, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import functions as L
from ledgerline.operators import relational as J
from ledgerline.operators import rows as R
from ledgerline.plans import Register, Tables

query = Register()
c = F.col


def intervals(t: Tables) -> DataFrame:
    """Orders as validity intervals of a year; those in status O are open."""
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", "o_custkey", day.alias("valid_from"), F.when(c("o_orderstatus") != "O", F.add_months(day, 12)).alias("valid_to"))


_INTERVALS = "iv AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN (o_orderdate + INTERVAL 12 MONTH)::DATE END AS valid_to FROM orders)"
_FIRST = "ev AS (SELECT o_custkey AS k, min(l_shipdate)::DATE AS event_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)"
_DAYS = "days AS (SELECT user_id, ts::DATE AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)"


def first_events(t: Tables) -> DataFrame:
    """The first returned item of each customer, as the default of a borrower."""
    rows = t.lineitem.where("l_returnflag = 'R'").join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return rows.groupBy(c("o_custkey").alias("k")).agg(F.to_date(F.min("l_shipdate")).alias("event_at"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice > 50000 AND l_quantity > 0 AND l_shipdate IS NOT NULL")
def F01_filter_valid(t: Tables) -> DataFrame:
    return t.lineitem.where("l_extendedprice > 50000 and l_quantity > 0 and l_shipdate is not null").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1e5 AND 2e5")
def F02_filter_between(t: Tables) -> DataFrame:
    return t.orders.where(c("o_totalprice").between(1e5, 2e5)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def F03_filter_in(t: Tables) -> DataFrame:
    return t.orders.where(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query(f"WITH {_INTERVALS} SELECT o_orderkey FROM iv WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')")
def F04_active_at(t: Tables) -> DataFrame:
    return intervals(t).where(L.active_at(F.lit("1998-06-30").cast("date"))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice / nullif(p_size, 0) <= 100")
def F05_plausible_segment(t: Tables) -> DataFrame:
    return t.part.where(L.safe_ratio("p_retailprice", "p_size", None) <= 100).select("p_partkey")


_YEARS = "y AS (SELECT o_custkey AS k, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)"


def years(t: Tables) -> DataFrame:
    return t.orders.groupBy(c("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("total"))


@query(f"WITH {_YEARS}, m AS (SELECT k, max(year) AS last FROM y GROUP BY 1), r AS (SELECT y.* FROM y JOIN m USING (k) WHERE year > last - 3) SELECT k, year, round(total, 2) AS total FROM r WHERE k IN (SELECT k FROM r GROUP BY k HAVING count(DISTINCT year) = 3)")
def F06_consecutive_years(t: Tables) -> DataFrame:
    return J.consecutive_years(years(t), "k", "year", 3).select("k", "year", F.round("total", 2).alias("total"))


@query(f"WITH {_FIRST} SELECT o_orderkey FROM orders LEFT JOIN ev ON k = o_custkey WHERE event_at IS NULL OR o_orderdate < event_at")
def F07_before_event(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", c("o_custkey").alias("k"), "o_orderdate")
    return J.before_event(rows, first_events(t), "k", "o_orderdate", "event_at").select("o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def F08_current_version(t: Tables) -> DataFrame:
    return J.keep_first(t.orders, ["o_custkey"], [c("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 20)")
def F09_exclude_hubs(t: Tables) -> DataFrame:
    return J.exclude_hubs(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", 20)


@query("SELECT o_orderkey FROM orders WHERE (o_orderdate + INTERVAL 12 MONTH)::DATE <= DATE '2000-12-31' AND o_orderstatus <> 'P'")
def F10_observable_only(t: Tables) -> DataFrame:
    return t.orders.where((F.add_months("o_orderdate", 12) <= F.lit("2000-12-31").cast("date")) & (c("o_orderstatus") != "P")).select("o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey <> l_suppkey")
def F11_no_self_loops(t: Tables) -> DataFrame:
    return t.lineitem.where("l_partkey <> l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1999-01-01'")
def F12_population_filter(t: Tables) -> DataFrame:
    return t.orders.where((c("o_orderstatus") == "F") & (c("o_orderdate") < F.lit("1999-01-01").cast("date"))).select("o_orderkey")


# ---------------------------------------------------------------- joins
@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def J01_star_join(t: Tables) -> DataFrame:
    return J.star_join(t.orders, [(t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]).select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def J02_inner_join(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def J03_map_join(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def J04_semi_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), c("l_orderkey") == c("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def J05_anti_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, c("l_orderkey") == c("o_orderkey"), "left_anti").select("o_orderkey")


@query(f"WITH {_DAYS}, u AS (SELECT user_id, ts::DATE AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, day::VARCHAR AS day, n, coalesce(errors, 0) AS errors FROM days LEFT JOIN u USING (user_id, day)")
def J06_composite_join(t: Tables) -> DataFrame:
    day = t.events.withColumn("day", F.to_date("ts"))
    errors = day.where("event_type = 'error'").groupBy("user_id", "day").agg(F.count("*").alias("errors"))
    return day.groupBy("user_id", "day").agg(F.count("*").alias("n")).join(errors, ["user_id", "day"], "left").select("user_id", c("day").cast("string").alias("day"), "n", F.coalesce("errors", F.lit(0)).alias("errors"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, asof_o_orderkey FROM (SELECT l.*, o.o_orderkey AS asof_o_orderkey, row_number() OVER (PARTITION BY l.i ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
FROM (SELECT row_number() OVER () AS i, li.*, o_custkey AS k FROM lineitem li JOIN orders ON l_orderkey = o_orderkey) l LEFT JOIN orders o ON o.o_custkey = l.k AND o.o_orderdate <= l.l_shipdate) WHERE r = 1""")
def J07_asof_join(t: Tables) -> DataFrame:
    """Each item with its customer's last order at the day of shipping."""
    left = t.lineitem.join(t.orders.select("o_orderkey", c("o_custkey").alias("k")), c("l_orderkey") == c("o_orderkey")).select("k", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    right = t.orders.select(c("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    return J.asof_join(left, right, "k", "l_shipdate", "o_orderdate", ["o_orderkey"], "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "asof_o_orderkey")


def month_ends(t: Tables) -> DataFrame:
    return t.orders.select(F.last_day("o_orderdate").alias("snapshot")).distinct()


@query(f"WITH {_INTERVALS}, s AS (SELECT DISTINCT last_day(o_orderdate) AS snapshot FROM orders) SELECT o_orderkey, snapshot::VARCHAR AS snapshot FROM iv JOIN s ON valid_from <= snapshot AND (valid_to IS NULL OR valid_to > snapshot)")
def J08_interval_join(t: Tables) -> DataFrame:
    return J.interval_join(intervals(t), month_ends(t), "snapshot").select("o_orderkey", c("snapshot").cast("string").alias("snapshot"))


_BRIDGE = "br AS (SELECT l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS hub, o_custkey AS member, min(l_shipdate)::DATE AS since FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def bridge(t: Tables) -> DataFrame:
    """Customers that bought the same part of the same supplier share an address, so to say."""
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return rows.groupBy(F.concat_ws("-", c("l_partkey").cast("string"), c("l_suppkey").cast("string")).alias("hub"), c("o_custkey").alias("member")).agg(F.to_date(F.min("l_shipdate")).alias("since"))


_PAIRS = f"""{_BRIDGE}, ok AS (SELECT hub FROM br GROUP BY 1 HAVING count(DISTINCT member) <= 20),
pairs AS (SELECT a.member AS a, b.member AS b, min(least(a.since, b.since)) AS since, count(*) AS hubs FROM br a JOIN br b ON a.hub = b.hub AND a.member < b.member WHERE a.hub IN (SELECT hub FROM ok) GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT a, b, since::VARCHAR AS since, hubs FROM pairs")
def J09_colocated_pairs(t: Tables) -> DataFrame:
    return J.colocated_pairs(bridge(t), "hub", "member", "since", 20).withColumn("since", c("since").cast("string"))


@query("""WITH d1 AS (SELECT p_type, p_size, list_sort(list(DISTINCT p_retailprice)) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), d2 AS (SELECT p_type, list_sort(list(DISTINCT p_retailprice)) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
d3 AS (SELECT list_sort(list(DISTINCT p_retailprice)) AS v FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(d1.v[p_partkey % len(d1.v) + 1], d2.v[p_partkey % len(d2.v) + 1], d3.v[p_partkey % len(d3.v) + 1]) AS donor, CASE WHEN d1.v IS NOT NULL THEN 1 WHEN d2.v IS NOT NULL THEN 2 ELSE 3 END::INTEGER AS tier
FROM part p LEFT JOIN d1 USING (p_type, p_size) LEFT JOIN d2 USING (p_type), d3 WHERE p_partkey % 2 = 1""")
def J10_tiered_match(t: Tables) -> DataFrame:
    rows, donors = t.part.where("p_partkey % 2 = 1").select("p_partkey", "p_type", "p_size"), t.part.where("p_partkey % 2 = 0").select("p_type", "p_size", "p_retailprice")
    return J.tiered_match(rows, donors, "p_partkey", [["p_type", "p_size"], ["p_type"], []], "p_retailprice").select("p_partkey", "donor", "tier")


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS j FROM supplier)
SELECT i AS rank, c_custkey, s_suppkey FROM a JOIN b ON i = (j + 2) // 3""")
def J11_rank_aligned_join(t: Tables) -> DataFrame:
    return J.rank_aligned_join(t.customer, "c_custkey", "c_acctbal", t.supplier, "s_suppkey", "s_acctbal", 3)


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS t FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS t FROM documents),
cand AS (SELECT item_id, doc_id, count(*) AS same FROM (SELECT item_id, unnest(t) AS x FROM b) JOIN (SELECT doc_id, unnest(t) AS x FROM d) USING (x) GROUP BY 1, 2)
SELECT item_id, doc_id, round(same / (len(b.t) + len(d.t) - same), 6) AS score FROM cand JOIN b USING (item_id) JOIN d USING (doc_id) WHERE same / (len(b.t) + len(d.t) - same) >= 0.2""")
def J12_fuzzy_token_join(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    return J.token_jaccard_join(t.benchmark.withColumn("t", words), t.documents.withColumn("t", words), "item_id", "doc_id", "t", 0.2).withColumn("score", F.round("score", 6))


@query("SELECT target, count(*) AS n, count(CASE WHEN side = 'left' THEN 1 END) AS n_left FROM (SELECT l_partkey AS target, 'left' AS side FROM lineitem UNION ALL SELECT l_suppkey, 'right' FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part)) GROUP BY 1")
def J13_either_side_join(t: Tables) -> DataFrame:
    rows = J.either_side_join(t.lineitem.select("l_partkey", "l_suppkey"), t.part.select("p_partkey"), "p_partkey", "l_partkey", "l_suppkey")
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.count(F.when(c("side") == "left", 1)).alias("n_left"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(s_name, p_name) AS owner FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_partkey LEFT JOIN part ON p_partkey = l_partkey")
def J14_polymorphic_key(t: Tables) -> DataFrame:
    return J.polymorphic_key(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", t.supplier.where("s_acctbal > 0").select("s_suppkey", "s_name"), t.part.select("p_partkey", "p_name"), "owner")


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT count(*) AS shared, round(corr(a.v, b.v), 6) AS correlation, round(max(abs(a.v - b.v)), 2) AS largest_difference FROM a JOIN b USING (k)""")
def J15_overlap_audit(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"))
    b = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return J.overlap_audit(a, b, "k", "v").select("shared", F.round("correlation", 6).alias("correlation"), F.round("largest_difference", 2).alias("largest_difference"))


@query("SELECT 'customer' AS node_type, c_custkey AS ref_id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def J16_node_names(t: Tables) -> DataFrame:
    kinds = [("customer", t.customer, "c_custkey", "c_name"), ("supplier", t.supplier, "s_suppkey", "s_name"), ("part", t.part, "p_partkey", "p_name")]
    named = [df.select(F.lit(kind).alias("node_type"), c(k).alias("ref_id"), c(n).alias("name")) for kind, df, k, n in kinds]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, max(l_extendedprice) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT k, x, y, x >= y AS ordered FROM a JOIN b USING (k)")
def J17_key_intersection_compare(t: Tables) -> DataFrame:
    a = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("x"))
    b = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).groupBy(c("o_custkey").alias("k")).agg(F.max("l_extendedprice").alias("y"))
    return a.join(b, "k").withColumn("ordered", c("x") >= c("y"))


@query("""WITH acc AS (SELECT DISTINCT l_suppkey AS account FROM lineitem UNION SELECT DISTINCT l_partkey FROM lineitem), rest AS (SELECT account FROM acc WHERE account NOT IN (SELECT c_custkey FROM customer))
SELECT account, 'CP-' || lpad(row_number() OVER (ORDER BY account)::VARCHAR, 6, '0') AS name FROM rest""")
def J18_flow_accounts(t: Tables) -> DataFrame:
    every = t.lineitem.select(c("l_suppkey").alias("account")).union(t.lineitem.select("l_partkey")).distinct()
    rest = every.join(t.customer, c("account") == c("c_custkey"), "left_anti")
    return R.add_row_id(rest, "n", ["account"]).select("account", L.format_id("CP", "n").alias("name"))


# ---------------------------------------------------------------- sorts and top-k
@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey")
def T01_order_by_many(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(c("o_orderstatus").asc_nulls_last(), c("o_totalprice").desc_nulls_last(), "o_orderkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def T02_top_k(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(c("total").desc(), "o_custkey").limit(10)


@query("SELECT o_custkey, o_orderkey, n_all, total FROM (SELECT o_custkey, o_orderkey, count(*) OVER w AS n_all, round(sum(o_totalprice) OVER w, 2) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey)) WHERE r <= 2")
def T03_head_keep_total(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    whole, order = W.partitionBy("o_custkey"), W.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey")
    return t.orders.withColumns({"n_all": F.count("*").over(whole), "total": F.round(F.sum("o_totalprice").over(whole), 2), "r": F.row_number().over(order)}).where("r <= 2").select("o_custkey", "o_orderkey", "n_all", "total")


@query("SELECT rank, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders) WHERE rank <= ceil(n * 0.1)")
def T04_top_fraction(t: Tables) -> DataFrame:
    return J.top_fraction(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.1).select("rank", "o_orderkey")


@query(f"""WITH {_PAIRS}, {_FIRST}, cand AS (SELECT a AS borrower, b AS candidate, hubs, ev.k IS NOT NULL AS defaulted, since FROM pairs LEFT JOIN ev ON ev.k = b)
SELECT borrower, candidate, r AS place, n_all > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY borrower ORDER BY defaulted DESC, hubs DESC, since, candidate) AS r, count(*) OVER (PARTITION BY borrower) AS n_all FROM cand) WHERE r <= 3""")
def T05_rank_candidates(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    pairs = J.colocated_pairs(bridge(t), "hub", "member", "since", 20)
    events = first_events(t).select(c("k").alias("b"), F.lit(True).alias("defaulted"))
    rows = pairs.join(events, "b", "left").withColumn("defaulted", F.coalesce("defaulted", F.lit(False)))
    order = W.partitionBy("a").orderBy(c("defaulted").desc(), c("hubs").desc(), "since", "b")
    return rows.withColumns({"place": F.row_number().over(order).cast("long"), "n_all": F.count("*").over(W.partitionBy("a"))}).where("place <= 3").select(c("a").alias("borrower"), c("b").alias("candidate"), "place", (c("n_all") > 3).alias("truncated"))


@query(f"""WITH {_PAIRS}, deg AS (SELECT m, count(*) AS degree FROM (SELECT a AS m FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1), last AS (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1)
SELECT m AS borrower, degree, last_order FROM deg LEFT JOIN last ON o_custkey = m ORDER BY degree DESC, m LIMIT 20""")
def T06_most_connected(t: Tables) -> DataFrame:
    pairs = J.colocated_pairs(bridge(t), "hub", "member", "since", 20)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("borrower")).groupBy("borrower").agg(F.count("*").alias("degree"))
    last = t.orders.groupBy(c("o_custkey").alias("borrower")).agg(F.max("o_orderkey").alias("last_order"))
    return degree.join(last, "borrower", "left").orderBy(c("degree").desc(), "borrower").limit(20)


# ---------------------------------------------------------------- set operations
@query("SELECT c_custkey AS id, c_acctbal AS balance, NULL::INTEGER AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def U01_union_all_aligned(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("balance")).unionByName(t.part.select(c("p_partkey").alias("id"), c("p_size").alias("size")), allowMissingColumns=True)


@query("SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def U02_union_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_partkey").alias("id")).union(t.lineitem.select("l_suppkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderdate < DATE '1998-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
def U03_intersect_keys(t: Tables) -> DataFrame:
    cut = F.lit("1998-01-01").cast("date")
    return t.orders.where(c("o_orderdate") < cut).select(c("o_custkey").alias("k")).intersect(t.orders.where(c("o_orderdate") >= cut).select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def U04_except_keys(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09) SELECT k, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def U05_symmetric_difference(t: Tables) -> DataFrame:
    return J.symmetric_difference(t.lineitem.where("l_returnflag = 'R'").select(c("l_partkey").alias("k")), t.lineitem.where("l_discount > 0.09").select(c("l_partkey").alias("k")))


@query("SELECT s_suppkey AS id, NULL::VARCHAR AS c_mktsegment, s_acctbal AS balance FROM supplier")
def U06_conform_to(t: Tables) -> DataFrame:
    return R.conform_to(t.supplier.select(c("s_suppkey").alias("id"), c("s_acctbal").alias("balance"), "s_name"), {"id": "bigint", "c_mktsegment": "string", "balance": "double"})


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderdate < DATE '1999-01-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1999-01-01')
SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM a INTERSECT SELECT o_orderkey FROM b)) AS shared, (SELECT max(o_orderdate) FROM a) < (SELECT min(o_orderdate) FROM b) AS apart""")
def U07_split_overlap_free(t: Tables) -> DataFrame:
    cut = F.lit("1999-01-01").cast("date")
    a, b = t.orders.where(c("o_orderdate") < cut), t.orders.where(c("o_orderdate") >= cut)
    shared = a.select("o_orderkey").intersect(b.select("o_orderkey")).agg(F.count("*").alias("shared"))
    return shared.crossJoin(a.agg(F.max("o_orderdate").alias("_a"))).crossJoin(b.agg(F.min("o_orderdate").alias("_b"))).select("shared", (c("_a") < c("_b")).alias("apart"))
