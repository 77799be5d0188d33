"""Queries over checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import functions as L
from ledgerline.operators import aggregates as A
from ledgerline.operators import evaluate as E
from ledgerline.operators import quality as Q
from ledgerline.operators import windows as V
from ledgerline.plans import Register, Tables
from ledgerline.plans.aggregates import _LABELLED, labelled_orders
from ledgerline.plans.credit import _ABT, targets
from ledgerline.plans.relational import _BRIDGE, _FIRST, bridge, first_events
from ledgerline.plans.windows import _CAP, _SCD, holdings, versions

query = Register()
c = F.col


def _row(check: str, count: str, critical: bool = True) -> str:
    return f"SELECT '{check}' AS \"check\", n = 0 AS passed, {critical} AS critical, n::BIGINT AS detail FROM ({count})"


_Q01 = [_row("orders.pk", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)"), _row("lineitem.pk", "SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)", False)]


@query(" UNION ALL ".join(_Q01))
def Q01_pk_unique(t: Tables) -> DataFrame:
    return Q.pk_unique(t.orders, ["o_orderkey"], "orders.pk").unionByName(Q.pk_unique(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem.pk", False))


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]


@query(" UNION ALL ".join(_row(f"{a}.{x}", f"SELECT count(*) AS n FROM {a} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {b})") for a, x, b, y in _FKS))
def Q02_fk_orphans(t: Tables) -> DataFrame:
    return Q.gate([Q.fk_orphans(getattr(t, a), x, getattr(t, b), y, f"{a}.{x}") for a, x, b, y in _FKS])


@query(" UNION ALL ".join(_row(n, f"SELECT count(CASE WHEN {bad} THEN 1 END) AS n FROM {table}") for n, table, bad in (("quantity", "lineitem", "NOT l_quantity BETWEEN 1 AND 50"), ("price", "lineitem", "l_extendedprice <= 0"), ("discount", "lineitem", "NOT l_discount BETWEEN 0 AND 0.05"), ("size", "part", "p_size < 1"))))
def Q03_range_checks(t: Tables) -> DataFrame:
    bad = {"quantity": ~c("l_quantity").between(1, 50), "price": c("l_extendedprice") <= 0, "discount": ~c("l_discount").between(0, 0.05)}
    counts = t.lineitem.agg(*[F.count_if(b).alias(n) for n, b in bad.items()])
    rows = [Q.result(counts.select(n), n) for n in bad]
    return Q.gate([*rows, Q.count_where(t.part, c("p_size") < 1, "size")])


@query(_row("shipped before ordered", "SELECT count(CASE WHEN l_shipdate < o_orderdate THEN 1 END) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"))
def Q04_temporal_order(t: Tables) -> DataFrame:
    return Q.count_where(t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")), c("l_shipdate") < c("o_orderdate"), "shipped before ordered")


@query("SELECT 'snapshot' AS \"check\", n = 0 AS passed, true AS critical, n AS detail FROM (SELECT count(CASE WHEN (date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE >= date_trunc('month', o_orderdate)::DATE THEN 1 END) AS n FROM orders) UNION ALL SELECT 'month of the event', n = 0, true, n FROM (SELECT count(CASE WHEN last_day(o_orderdate) >= o_orderdate AND last_day(o_orderdate) > date_trunc('month', o_orderdate) + INTERVAL 27 DAY THEN 1 END) AS n FROM orders)")
def Q05_pit_snapshot_check(t: Tables) -> DataFrame:
    """No snapshot lies in its order's month; the month-end of the order itself, as a naive one, is caught."""
    rows = t.orders.withColumns({"snapshot": L.previous_month_end("o_orderdate"), "naive": L.month_end("o_orderdate")})
    late = Q.count_where(rows, c("snapshot") >= F.trunc("o_orderdate", "month"), "snapshot")
    return late.unionByName(Q.count_where(rows, (c("naive") >= c("o_orderdate")) & (c("naive") > F.date_add(F.trunc("o_orderdate", "month"), 27)), "month of the event"))


@query("""WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_shipdate <= DATE '1998-06-30'), d1 AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY 1), d3 AS (SELECT x, sum(n)::BIGINT AS n FROM (SELECT a AS x, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT b, count(*) FROM e GROUP BY 1) GROUP BY 1),
d2 AS (SELECT x, count(*) AS n FROM (SELECT l_partkey AS x FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1), r AS (SELECT (SELECT count(*) FROM d1 FULL JOIN d3 USING (x) WHERE d1.n IS DISTINCT FROM d3.n) AS one, (SELECT count(*) FROM d1 FULL JOIN d2 USING (x) WHERE d1.n IS DISTINCT FROM d2.n) AS two)
SELECT 'degree' AS "check", one = 0 AS passed, true AS critical, one AS detail FROM r UNION ALL SELECT 'filter bites', two > 0, true, two FROM r""")
def Q06_degree_recompute(t: Tables) -> DataFrame:
    """Degrees found twice agree, by adding up ends and by adding up edges; and the date filter changes them."""
    now = t.lineitem.where(c("l_shipdate") <= F.lit("1998-06-30").cast("date"))
    one = A.degrees(now, "l_partkey", "l_suppkey")
    sides = [now.groupBy(c(x).alias("node")).agg(F.count("*").alias("m")) for x in ("l_partkey", "l_suppkey")]
    two = sides[0].unionByName(sides[1]).groupBy("node").agg(F.sum("m").alias("m"))
    differ = lambda a, b: a.join(b, "node", "full").agg(F.count_if(~c("degree").eqNullSafe(c("m"))).alias("n"))
    every = A.degrees(t.lineitem, "l_partkey", "l_suppkey").withColumnRenamed("degree", "m")
    bites = differ(one, every).select(F.lit("filter bites").alias("check"), (c("n") > 0).alias("passed"), F.lit(True).alias("critical"), c("n").alias("detail"))
    return Q.result(differ(one, two), "degree").unionByName(bites)


@query("SELECT 'columns' AS \"check\", n = 0 AS passed, true AS critical, n AS detail FROM (SELECT count(*) AS n FROM (SELECT column_name FROM (DESCRIBE orders) UNION ALL SELECT column_name FROM (DESCRIBE customer)) WHERE column_name = 'o_orderstatus' OR NOT starts_with(column_name, 'o_'))")
def Q07_forbidden_columns(t: Tables) -> DataFrame:
    """Of orders with their customers the columns that are forbidden or not of the orders."""
    return Q.forbidden_columns(t.orders.join(t.customer, c("o_custkey") == c("c_custkey")), ["o_orderstatus"], ["o_"], "columns")


@query(f"WITH {_ABT} " + _row("censoring", "SELECT count(CASE WHEN y_censored <> ((CASE WHEN NOT y_censored THEN hit::INTEGER END) IS NULL) THEN 1 END) AS n FROM y"))
def Q08_censor_consistency(t: Tables) -> DataFrame:
    return Q.count_where(targets(t), c("y_censored") != c("y").isNull(), "censoring")


@query(f"WITH {_LABELLED} SELECT 'rate' AS \"check\", avg(y) BETWEEN 0.01 AND 0.6 AND count(y) >= 20 AS passed, true AS critical, coalesce(sum(y), 0)::BIGINT AS detail FROM lab")
def Q09_rate_bounds(t: Tables) -> DataFrame:
    return labelled_orders(t).agg(F.lit("rate").alias("check"), (F.avg("y").between(0.01, 0.6) & (F.count("y") >= 20)).alias("passed"), F.lit(True).alias("critical"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("detail"))


@query(_row("split", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1998-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')"))
def Q10_split_disjoint(t: Tables) -> DataFrame:
    cut = F.lit("1998-01-01").cast("date")
    both = t.orders.where(c("o_orderdate") < cut).select("o_custkey").intersect(t.orders.where(c("o_orderdate") >= cut).select("o_custkey"))
    return Q.result(both.agg(F.count("*").alias("n")), "split")


@query("WITH a AS (SELECT substr(column_name, 3) AS x FROM (DESCRIBE customer)), b AS (SELECT substr(column_name, 3) AS x FROM (DESCRIBE supplier)), n AS (SELECT count(*) AS n FROM a FULL JOIN b ON a.x = b.x WHERE a.x IS NULL OR b.x IS NULL) SELECT 'parity' AS \"check\", n = 0 AND (SELECT count(*) FROM customer) >= 10 AS passed, true AS critical, n AS detail FROM n")
def Q11_feature_space_parity(t: Tables) -> DataFrame:
    """Columns, by their names without the table's prefix, that just one of two tables has; a table of too few rows fails as well."""
    apart = len({x[2:] for x in t.customer.columns} ^ {x[2:] for x in t.supplier.columns})
    return t.customer.agg(F.lit("parity").alias("check"), ((F.count("*") >= 10) & F.lit(apart == 0)).alias("passed"), F.lit(True).alias("critical"), F.lit(apart).cast("long").alias("detail"))


@query("SELECT 'tails' AS \"check\", n = 0 AS passed, false AS critical, n::BIGINT AS detail FROM (SELECT (max(value) > 2 * quantile_cont(value, 0.99))::INTEGER AS n FROM events)")
def Q12_tail_ratio(t: Tables) -> DataFrame:
    return Q.tail_ratio(t.events, ["value"], 2.0, "tails")


@query(f"WITH {_BRIDGE}, h AS (SELECT hub, count(DISTINCT member) AS m, count(DISTINCT c_nationkey) AS g FROM br JOIN customer ON c_custkey = member GROUP BY 1) SELECT 'hubs over 20' AS \"check\", count(CASE WHEN m > 20 THEN 1 END) = 0 AS passed, true AS critical, count(CASE WHEN m > 20 THEN 1 END) AS detail FROM h UNION ALL SELECT 'cross-group links', count(CASE WHEN g > 1 THEN 1 END) > 0, false, count(CASE WHEN g > 1 THEN 1 END) FROM h")
def Q14_address_checks(t: Tables) -> DataFrame:
    """Members are counted as rows, as a hub has each once, and groups by their bounds, so no task holds a hub's members."""
    homes = t.customer.groupBy("c_custkey").agg(F.min("c_nationkey").alias("low"), F.max("c_nationkey").alias("high"))
    hubs = bridge(t).join(homes, c("member") == c("c_custkey")).groupBy("hub").agg(F.count("*").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"))
    sums = hubs.agg(F.count_if(c("m") > 20).alias("many"), F.count_if(c("low") < c("high")).alias("crossing"))
    row = lambda check, passed, critical, n: F.struct(F.lit(check).alias("check"), passed.alias("passed"), F.lit(critical).alias("critical"), c(n).alias("detail"))
    return sums.select(F.inline(F.array(row("hubs over 20", c("many") == 0, True, "many"), row("cross-group links", c("crossing") > 0, False, "crossing"))))


@query(f"WITH {_SCD} " + _row("versions", "SELECT count(CASE WHEN p IS NULL AND q IS NOT NULL OR p >= valid_from THEN 1 END) AS n FROM (SELECT *, lag(valid_to) OVER (PARTITION BY k ORDER BY valid_from) AS p, lag(valid_from) OVER (PARTITION BY k ORDER BY valid_from) AS q FROM v)"))
def Q15_scd2_no_overlap(t: Tables) -> DataFrame:
    return Q.scd2_no_overlap(versions(t), "k", "versions")


@query(f"WITH {_CAP} " + _row("shares", "SELECT count(*) AS n FROM (SELECT k, valid_from, sum(share) AS s FROM cap WHERE valid_to IS NULL OR valid_to > valid_from GROUP BY 1, 2) WHERE abs(s - 1) > 1e-9"))
def Q16_shares_sum_to_one(t: Tables) -> DataFrame:
    totals = V.cap_table(holdings(t), "rel", "k", "w").where("valid_to is null or valid_to > valid_from").groupBy("k", "valid_from").agg(F.sum("share").alias("s"))
    return Q.count_where(totals, F.abs(c("s") - 1) > 1e-9, "shares")


@query(_row("provenance", "SELECT count(CASE WHEN o_custkey IS NULL OR o_orderdate IS NULL THEN 1 END) AS n FROM orders"))
def Q17_provenance_not_null(t: Tables) -> DataFrame:
    return Q.count_where(t.orders, c("o_custkey").isNull() | c("o_orderdate").isNull(), "provenance")


@query(" UNION ALL ".join([*_Q01, _row("provenance", "SELECT count(CASE WHEN o_custkey IS NULL THEN 1 END) AS n FROM orders")]))
def Q18_quality_gate(t: Tables) -> DataFrame:
    return Q.gate([Q.pk_unique(t.orders, ["o_orderkey"], "orders.pk"), Q.pk_unique(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem.pk", False), Q.count_where(t.orders, c("o_custkey").isNull(), "provenance")])


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT i - 1 AS component, round(var_samp(v::DOUBLE), 8) AS variance, arg_max(v, (abs(v), -vec_id)) > 0 AS positive FROM e GROUP BY 1""")
def Q19_embedding_canonical(t: Tables) -> DataFrame:
    """Per component its variance and whether the entry of the largest size is positive."""
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("component", "v")).withColumn("v", c("v").cast("double"))
    return rows.groupBy(c("component").cast("long").alias("component")).agg(F.round(F.var_samp("v"), 8).alias("variance"), (F.max_by("v", F.struct(F.abs("v"), -c("vec_id"))) > 0).alias("positive"))


@query("WITH r AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS x FROM lineitem GROUP BY 1) SELECT count(*) AS orders, count(CASE WHEN abs(x - o_totalprice) > 1 THEN 1 END) AS off, round(max(abs(x - o_totalprice)), 2) AS largest_error FROM orders JOIN r ON k = o_orderkey")
def Q20_formula_reconstruction(t: Tables) -> DataFrame:
    """Totals of orders worked out anew from their lines, and how many differ by more than one."""
    p, d = c("l_extendedprice"), c("l_discount")
    found = t.lineitem.groupBy("l_orderkey").agg(F.sum(p * (1 - d) * (1 + c("l_tax"))).alias("x"))
    error = F.abs(c("x") - c("o_totalprice"))
    return t.orders.join(found, c("l_orderkey") == c("o_orderkey")).agg(F.count("*").alias("orders"), F.count_if(error > 1).alias("off"), F.round(F.max(error), 2).alias("largest_error"))


@query(f"WITH {_FIRST}, {_BRIDGE}, f AS (SELECT member, min(since) AS since FROM br GROUP BY 1), g AS (SELECT c_nationkey AS grp, min(event_at) AS source, min(since) AS infected, count(DISTINCT c_mktsegment) AS spans FROM customer LEFT JOIN ev ON ev.k = c_custkey LEFT JOIN f ON member = c_custkey GROUP BY 1) SELECT grp, source <= infected AS backward, spans > 1 AS crossing FROM g")
def Q21_contagion_backward_only(t: Tables) -> DataFrame:
    first = bridge(t).groupBy("member").agg(F.min("since").alias("since"))
    rows = t.customer.join(first_events(t), c("k") == c("c_custkey"), "left").join(first, c("member") == c("c_custkey"), "left")
    return rows.groupBy(c("c_nationkey").alias("grp")).agg((F.min("event_at") <= F.min("since")).alias("backward"), (F.countDistinct("c_mktsegment") > 1).alias("crossing"))


@query("SELECT 'p_brand' AS name, p_brand AS value FROM (SELECT p_brand FROM part WHERE p_size > 1 EXCEPT SELECT p_brand FROM part WHERE p_size <= 1) UNION ALL SELECT 'p_name', p_name FROM (SELECT p_name FROM part WHERE p_size > 1 EXCEPT SELECT p_name FROM part WHERE p_size <= 1)")
def Q22_unseen_categories(t: Tables) -> DataFrame:
    test, train = t.part.where("p_size > 1"), t.part.where("p_size <= 1")
    rows = [test.select(c(x).alias("value")).subtract(train.select(x)).select(F.lit(x).alias("name"), "value") for x in ("p_brand", "p_name")]
    return rows[0].unionByName(rows[1])


@query(f"WITH {_LABELLED}, s AS (SELECT o_custkey, coalesce(sum(y), 0) AS e FROM lab GROUP BY 1), r AS (SELECT o_custkey, e, row_number() OVER (ORDER BY e DESC, md5(o_custkey::VARCHAR), o_custkey) - 1 AS i FROM s), f AS (SELECT o_custkey, e, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INTEGER AS fold FROM r) SELECT fold, sum(e)::BIGINT AS events, count(*) AS grps, 0::BIGINT + (SELECT count(*) FROM (SELECT o_custkey FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS split_groups FROM f GROUP BY 1")
def Q23_fold_audit(t: Tables) -> DataFrame:
    """The folds of customers: events and groups of each, and how many groups lie in several."""
    rows = labelled_orders(t)
    folds = E.group_folds(rows, "o_custkey", "y", 5)
    events = rows.groupBy("o_custkey").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("e"))
    torn = folds.groupBy("o_custkey").agg(F.countDistinct("fold").alias("n")).where("n > 1").agg(F.count("*").alias("split_groups"))
    return folds.join(events, "o_custkey").groupBy("fold").agg(F.sum("e").cast("long").alias("events"), F.count("*").alias("grps")).crossJoin(F.broadcast(torn))
