"""Queries over window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ledgerline import functions as L
from ledgerline.operators import aggregates as A
from ledgerline.operators import relational as J
from ledgerline.operators import windows as V
from ledgerline.plans import Register, Tables
from ledgerline.plans.aggregates import _WORST
from ledgerline.plans.relational import _YEARS, years

query = Register()
c = F.col
_PANEL = "p AS (SELECT user_id AS k, ts::DATE AS day, count(*) AS n, round(sum(value), 2) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1, 2)"


def panel(t: Tables) -> DataFrame:
    """Days of users, as facility and month."""
    return t.events.groupBy(c("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_if(c("event_type") == "error").alias("errors"))


def by_day() -> WindowSpec:
    return W.partitionBy("k").orderBy("day")


def day() -> Column:
    return c("day").cast("string").alias("day")


@query("SELECT c_custkey, round(row_number() OVER (ORDER BY c_acctbal, c_custkey) / count(*) OVER (), 8) AS pct FROM customer")
def W01_percent_rank_first(t: Tables) -> DataFrame:
    return V.percent_rank_first(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "pct").select("c_custkey", F.round("pct", 8).alias("pct"))


@query("SELECT c_custkey, greatest(1, least(5, ceil(round(row_number() OVER (ORDER BY c_acctbal, c_custkey) / count(*) OVER () * 5, 9))))::BIGINT AS quintile FROM customer")
def W02_quantile_bucket(t: Tables) -> DataFrame:
    ranked = V.percent_rank_first(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "pct")
    return ranked.select("c_custkey", V.quantile_bucket(c("pct"), 5).alias("quintile"))


@query(f"WITH {_YEARS} SELECT k, year, round((total - lag(total) OVER w) / nullif(lag(total) OVER w, 0), 6) AS growth FROM y WINDOW w AS (PARTITION BY k ORDER BY year)")
def W03_pct_change(t: Tables) -> DataFrame:
    before = F.lag("total").over(W.partitionBy("k").orderBy("year"))
    return years(t).select("k", "year", F.round(L.safe_ratio(c("total") - before, before, None), 6).alias("growth"))


@query(f"WITH {_YEARS} SELECT k, year, round(total - first_value(total) OVER (PARTITION BY k ORDER BY year), 2) AS delta FROM y")
def W04_delta_from_first(t: Tables) -> DataFrame:
    return years(t).select("k", "year", F.round(c("total") - F.first("total").over(W.partitionBy("k").orderBy("year")), 2).alias("delta"))


@query(f"WITH {_PANEL} SELECT k, day::VARCHAR AS day, max(n) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS worst FROM p")
def W05_rolling_max(t: Tables) -> DataFrame:
    return panel(t).select("k", day(), F.max("n").over(by_day().rowsBetween(-2, 0)).alias("worst"))


@query(f"WITH {_PANEL} SELECT k, day::VARCHAR AS day, round(avg(total) OVER w, 6) AS mean, round(total - avg(total) OVER w, 6) AS gap FROM p WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def W06_rolling_mean(t: Tables) -> DataFrame:
    mean = F.avg("total").over(by_day().rowsBetween(-2, 0))
    return panel(t).select("k", day(), F.round(mean, 6).alias("mean"), F.round(c("total") - mean, 6).alias("gap"))


@query(f"WITH {_PANEL} SELECT k, day::VARCHAR AS day, round(total - lag(total) OVER w, 2) AS d1, round(total - lag(total, 3) OVER w, 2) AS d3, coalesce(n - lag(n) OVER w, 0) AS n1 FROM p WINDOW w AS (PARTITION BY k ORDER BY day)")
def W07_lag_delta(t: Tables) -> DataFrame:
    return panel(t).select("k", day(), F.round(c("total") - F.lag("total").over(by_day()), 2).alias("d1"), F.round(c("total") - F.lag("total", 3).over(by_day()), 2).alias("d3"), F.coalesce(c("n") - F.lag("n").over(by_day()), F.lit(0)).alias("n1"))


@query(f"WITH {_PANEL} SELECT k, day::VARCHAR AS day, coalesce(errors - lag(errors) OVER (PARTITION BY k ORDER BY day), 0) > 0 AS worsened FROM p")
def W08_worsened_flag(t: Tables) -> DataFrame:
    return panel(t).select("k", day(), (F.coalesce(c("errors") - F.lag("errors").over(by_day()), F.lit(0)) > 0).alias("worsened"))


@query(f"WITH {_YEARS} SELECT k, year, dense_rank() OVER (PARTITION BY k ORDER BY year) AS place, year = max(year) OVER (PARTITION BY k) AS is_last FROM y")
def W09_dense_year_order(t: Tables) -> DataFrame:
    return years(t).select("k", "year", F.dense_rank().over(W.partitionBy("k").orderBy("year")).cast("long").alias("place"), (c("year") == F.max("year").over(W.partitionBy("k"))).alias("is_last"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 0), 8) AS share FROM lineitem")
def W10_group_total(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(L.safe_ratio("l_extendedprice", F.sum("l_extendedprice").over(W.partitionBy("l_orderkey")), None), 8).alias("share"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def W11_keep_first(t: Tables) -> DataFrame:
    return J.keep_first(t.orders, ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0) / count(*) OVER (PARTITION BY l_returnflag), 8) AS pct FROM lineitem")
def W12_pct_rank_in_type(t: Tables) -> DataFrame:
    """Only the distinct values of each type are ranked; their ranks are joined back."""
    counts = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    run = W.partitionBy("l_returnflag").orderBy("l_quantity")
    ranks = counts.withColumn("pct", (F.sum("n").over(run) - (c("n") - 1) / 2) / F.sum("n").over(W.partitionBy("l_returnflag")))
    return t.lineitem.join(ranks, ["l_returnflag", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("pct", 8).alias("pct"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS so_far FROM orders")
def W13_running_sum(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)), 2).alias("so_far"))


@query("WITH g AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, round((rank() OVER (ORDER BY a DESC) + rank() OVER (ORDER BY b DESC) + rank() OVER (ORDER BY n DESC)) / 3.0, 6) AS mean_rank FROM g")
def W14_average_of_ranks(t: Tables) -> DataFrame:
    rows = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"), F.count("*").alias("n"))
    ranks = [F.rank().over(W.orderBy(c(x).desc())) for x in ("a", "b", "n")]  # one row a brand
    return rows.select("p_brand", F.round((ranks[0] + ranks[1] + ranks[2]) / 3, 6).alias("mean_rank"))


_SCD = """d AS (SELECT o_custkey AS k, o_orderdate::DATE AS day, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1, 2), ch AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY day) AS p FROM d),
v AS (SELECT k, v, day AS valid_from, (lead(day) OVER (PARTITION BY k ORDER BY day) - INTERVAL 1 DAY)::DATE AS valid_to FROM ch WHERE p IS NULL OR p <> v)"""


def versions(t: Tables) -> DataFrame:
    rows = t.orders.select(c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), c("o_orderpriority").alias("v"), "o_orderkey")
    return V.scd2_from_changes(rows, "k", "day", "v", "o_orderkey")


@query(f"WITH {_SCD} SELECT k, v, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, valid_to IS NULL AS is_current FROM v")
def W15_scd2_from_changes(t: Tables) -> DataFrame:
    return versions(t).withColumns({x: c(x).cast("string") for x in ("valid_from", "valid_to")})


def holdings(t: Tables) -> DataFrame:
    """Orders as holdings of a customer's nation-wide company: a weight over a validity; every 50th has no length."""
    start = F.to_date("o_orderdate")
    end = F.when(c("o_orderkey") % 50 == 0, start).when(c("o_orderstatus") != "O", F.add_months(start, 12))
    return t.orders.select(c("o_orderkey").alias("rel"), c("o_custkey").alias("k"), F.floor("o_totalprice").cast("double").alias("w"), start.alias("valid_from"), end.alias("valid_to"))


_HOLD = "h AS (SELECT o_orderkey AS rel, o_custkey AS k, floor(o_totalprice) AS w, o_orderdate::DATE AS f, CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate::DATE WHEN o_orderstatus <> 'O' THEN (o_orderdate + INTERVAL 12 MONTH)::DATE ELSE DATE '9999-12-31' END AS e FROM orders)"
_CAP = f"""{_HOLD}, marks AS (SELECT k, f AS a FROM h UNION SELECT k, e FROM h), seg AS (SELECT k, a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM marks),
act AS (SELECT h.rel, h.k, h.w, a, b, round(w / sum(w) OVER (PARTITION BY h.k, a), 4) AS s FROM h JOIN seg ON h.k = seg.k AND f <= a AND e >= b WHERE b IS NOT NULL),
bal AS (SELECT *, round(1 - sum(s) OVER (PARTITION BY k, a), 4) AS rest, row_number() OVER (PARTITION BY k, a ORDER BY s DESC, rel) AS r FROM act),
cap AS (SELECT rel, k, round(s + CASE WHEN r = 1 THEN rest ELSE 0 END, 4) AS share, a AS valid_from, CASE WHEN b <> DATE '9999-12-31' THEN b END AS valid_to FROM bal
 UNION ALL SELECT rel, k, round(w / sum_w, 4), f, e FROM h JOIN (SELECT k, sum(w) AS sum_w FROM h GROUP BY 1) USING (k) WHERE e <= f)"""


@query(f"WITH {_CAP} SELECT rel, k, round(share, 4) AS share, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM cap")
def W16_cap_table_segments(t: Tables) -> DataFrame:
    return V.cap_table(holdings(t), "rel", "k", "w").withColumns({x: c(x).cast("string") for x in ("valid_from", "valid_to")})


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber || '-' || l_partkey AS line, floor(sum(l_extendedprice)) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, round(w / sum(w) OVER (PARTITION BY k), 4) AS s FROM s), b AS (SELECT *, round(1 - sum(s) OVER (PARTITION BY k), 4) AS rest, row_number() OVER (PARTITION BY k ORDER BY s DESC, line) AS i FROM r) SELECT k, line, round(s + CASE WHEN i = 1 THEN rest ELSE 0 END, 4) AS share FROM b")
def W17_balance_rounding(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(c("l_orderkey").alias("k"), F.concat_ws("-", c("l_linenumber").cast("string"), c("l_partkey").cast("string")).alias("line")).agg(F.floor(F.sum("l_extendedprice")).cast("double").alias("w"))
    return V.balance(rows, ["k"], "w", "share", "line").select("k", "line", "share")


@query(f"WITH {_CAP} SELECT rel, k, round(arg_min(share, (valid_from, share)), 4) AS share, min(valid_from)::VARCHAR AS valid_from, CASE WHEN NOT bool_or(valid_to IS NULL) THEN max(valid_to) END::VARCHAR AS valid_to FROM cap GROUP BY 1, 2")
def W18_collapse_segments(t: Tables) -> DataFrame:
    return V.collapse(V.cap_table(holdings(t), "rel", "k", "w"), "rel", "k").withColumns({x: c(x).cast("string") for x in ("valid_from", "valid_to")})


@query("WITH b AS (SELECT quantile_cont(value, [0.01, 0.99]) AS q FROM events) SELECT event_id, round(greatest(q[1], least(q[2], value)), 6) AS value FROM events, b")
def W19_winsorize(t: Tables) -> DataFrame:
    return V.winsorize(t.events.select("event_id", "value"), ["value"]).select("event_id", F.round("value", 6).alias("value"))


_AVG = "(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count({v}) OVER ()"
_SCORE = f"r AS (SELECT c_custkey, {_AVG.format(v='c_acctbal')} AS a, {_AVG.format(v='c_nationkey')} AS b FROM customer), m AS (SELECT c_custkey, round((b - a) / 2, 10) AS x FROM r), sc AS (SELECT c_custkey, round({_AVG.format(v='x')} * 100, 2) AS score FROM m)"


def scores(t: Tables) -> DataFrame:
    """Mean of the percentile ranks of two figures (the balance counting against), ranked again, from 0 to 100."""
    rows = V.percentile_rank(V.percentile_rank(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), "c_acctbal", "a"), "c_nationkey", "b")
    rows = rows.select("c_custkey", F.round((c("b") - c("a")) / 2, 10).alias("x"))
    return V.percentile_rank(rows, "x", "p").select("c_custkey", F.round(c("p") * 100, 2).alias("score"))


@query(f"WITH {_SCORE} SELECT c_custkey, score FROM sc")
def W20_composite_score(t: Tables) -> DataFrame:
    return scores(t)


@query(f"WITH {_SCORE}, f AS (SELECT o_orderpriority AS grade, sum(count(*)) OVER (ORDER BY o_orderpriority) / (SELECT count(*) FROM orders) AS bound FROM orders GROUP BY 1) SELECT c_custkey, coalesce((SELECT arg_min(grade, bound) FROM f WHERE round(bound, 9) >= round(score / 100, 9)), '5-LOW') AS grade FROM sc")
def W21_calibrate_to_distribution(t: Tables) -> DataFrame:
    bounds = A.frequencies(t.orders, "o_orderpriority", _WORST).select(F.struct(F.round("cumulative", 9).alias("bound"), c("o_orderpriority").alias("grade")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("bounds"))
    fit = F.filter("bounds", lambda x: x["bound"] >= F.round(c("score") / 100, 9))
    return scores(t).crossJoin(F.broadcast(bounds)).select("c_custkey", F.coalesce(F.get(fit, 0)["grade"], F.lit(_WORST[-1])).alias("grade"))


@query("SELECT c_custkey, round(exp(ln(30) + row_number() OVER (ORDER BY c_acctbal, c_custkey) / count(*) OVER () * (ln(300) - ln(30))), 6) AS scaled FROM customer")
def W22_rank_scale(t: Tables) -> DataFrame:
    import math

    lo, hi = math.log(30), math.log(300)
    ranked = V.percent_rank_first(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "pct")
    return ranked.select("c_custkey", F.round(F.exp(lo + c("pct") * (hi - lo)), 6).alias("scaled"))


@query("WITH e AS (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate) AS age FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT *, row_number() OVER (ORDER BY age, o_orderkey) / count(*) OVER () AS p FROM e) SELECT o_orderkey, CASE WHEN round(60 + p * 670) <= 365 THEN round(60 + p * 670)::BIGINT END AS age FROM r")
def W23_rank_map_to_window(t: Tables) -> DataFrame:
    """Ages of events on 60 to 730 days by rank; beyond a year they stay censored."""
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("age"))
    mapped = F.round(60 + c("p") * 670).cast("long")
    return V.percent_rank_first(rows, "age", "o_orderkey", "p").select("o_orderkey", F.when(mapped <= 365, mapped).alias("age"))


@query("SELECT conv_id, turn, h FROM (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM conversations) WHERE h IS NOT NULL")
def W24_carry_forward_header(t: Tables) -> DataFrame:
    head = F.last(F.when(c("role") == "user", F.length("text").cast("long")), ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return t.conversations.select("conv_id", "turn", head.alias("h")).where("h is not null")
