"""Queries over credit tables and policy arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline import functions as L
from ledgerline.operators import quantiles as Q
from ledgerline.operators import aggregates as A
from ledgerline.operators import credit as K
from ledgerline.operators import relational as J
from ledgerline.operators import rows as R
from ledgerline.plans import Register, Tables
from ledgerline.plans.relational import _FIRST, _YEARS, first_events, years

query = Register()
c = F.col
_KINDS = ["none", "receivables", "inventory", "machinery", "guarantee", "land", "cash"]


def applications(t: Tables) -> DataFrame:
    """Orders as applications; amounts are scaled to those of the policy."""
    k = c("o_orderkey")
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    sales, asked = (c("c_acctbal") + 1500) * 2e7, c("o_totalprice") * 4e5
    return rows.select(
        k.alias("id"), c("o_custkey").alias("borrower"), F.to_date("o_orderdate").alias("day"), asked.alias("asked"), sales.alias("sales"), (sales * 0.11).alias("ebitda"), (asked * 0.6).alias("debt"),
        (sales * 0.3).alias("equity"), (sales * 0.4 + asked).alias("liabilities"), F.when(k % 9 != 0, asked * 0.6 * 0.09).otherwise(0.0).alias("interest"), (sales * 0.05).alias("net_income"), (sales * 0.9).alias("assets"),
        (12 + (k % 5) * 12).cast("int").alias("months"), (0.06 + (k % 10) / 100).alias("rate"), (asked * (k % 30) / 15).alias("collateral"), (k % 7 == 0).alias("revolving"),
        F.element_at(F.array(*map(F.lit, _KINDS)), (k % 7 + 1).cast("int")).alias("kind"), ((k % 97) / 97 * 0.25).alias("pd"), ((k % 11) / 11).alias("lgd"), (asked * (k % 40) / 10).alias("exposure"), (k % 5 + 1).cast("int").alias("entities"),
        (k % 200).cast("int").alias("dpd"), "o_orderstatus", "c_mktsegment",
    )


_APP = """app AS (SELECT *, asked * (id % 40) / 10 AS exposure FROM (SELECT o_orderkey AS id, o_custkey AS borrower, o_orderdate::DATE AS day, o_totalprice * 4e5 AS asked, (c_acctbal + 1500) * 2e7 AS sales, (c_acctbal + 1500) * 2e7 * 0.11 AS ebitda,
 o_totalprice * 4e5 * 0.6 AS debt, (c_acctbal + 1500) * 2e7 * 0.3 AS equity, (c_acctbal + 1500) * 2e7 * 0.4 + o_totalprice * 4e5 AS liabilities, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice * 4e5 * 0.6 * 0.09 ELSE 0 END AS interest,
 (c_acctbal + 1500) * 2e7 * 0.05 AS net_income, (c_acctbal + 1500) * 2e7 * 0.9 AS assets, (12 + (o_orderkey % 5) * 12)::INTEGER AS months, 0.06 + (o_orderkey % 10) / 100 AS rate, o_totalprice * 4e5 * (o_orderkey % 30) / 15 AS collateral,
 o_orderkey % 7 = 0 AS revolving, ['none', 'receivables', 'inventory', 'machinery', 'guarantee', 'land', 'cash'][o_orderkey % 7 + 1] AS kind, (o_orderkey % 97)::DOUBLE / 97 * 0.25 AS pd, (o_orderkey % 11)::DOUBLE / 11 AS lgd,
 (o_orderkey % 5 + 1)::INTEGER AS entities, (o_orderkey % 200)::INTEGER AS dpd, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)),
gr AS (SELECT *, CASE WHEN pd <= 0.008 THEN 'AAA' WHEN pd <= 0.016 THEN 'AA' WHEN pd <= 0.03 THEN 'A' WHEN pd <= 0.055 THEN 'BBB' WHEN pd <= 0.095 THEN 'BB' WHEN pd <= 0.185 THEN 'B' ELSE 'CCC' END AS grade,
 CASE WHEN revolving THEN asked * rate / 12 ELSE asked * (rate / 12) / (1 - pow(1 + rate / 12, -months)) END AS pay,
 CASE WHEN pd <= 0.0762 THEN 'low' WHEN pd <= 0.2921 THEN 'medium' WHEN pd <= 0.706 THEN 'high' ELSE 'very high' END AS band FROM app)"""


def _case(values: dict[str, float]) -> str:
    return "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def graded(t: Tables) -> DataFrame:
    return applications(t).withColumns({"grade": K.grade_from_pd("pd"), "pay": K.instalment("asked", "months", "rate", c("revolving")), "band": K.band("pd")})


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(v, digits).alias(n) for n, v in columns.items()]


_ABT = f"""{_FIRST}, t AS (SELECT o.*, event_at, (o_orderdate + INTERVAL 12 MONTH)::DATE AS h FROM orders o LEFT JOIN ev ON ev.k = o_custkey),
y AS (SELECT *, coalesce(event_at <= h, false) AS hit, h > DATE '2000-06-30' AND NOT coalesce(event_at <= h, false) AS y_censored FROM t)"""


def targets(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("day", F.to_date("o_orderdate")).join(first_events(t), c("k") == c("o_custkey"), "left")
    return rows.withColumns(K.horizon_target("day", "event_at", 12, "2000-06-30"))


@query(f"""WITH {_ABT}, a AS (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS v, bool_or(l_returnflag = 'R') AS liquid FROM lineitem GROUP BY 1)
SELECT o_orderkey AS application_id, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderdate <= DATE '1999-06-30' THEN 'train' ELSE 'oot' END AS split, o_totalprice AS app_limit, n AS app_collaterals, v AS app_value, liquid AS app_liquid, c_acctbal AS fin_balance,
CASE WHEN NOT y_censored THEN hit::INTEGER END AS y, y_censored, date_diff('day', o_orderdate, event_at) AS y_age, date_diff('day', o_orderdate, coalesce(event_at, DATE '2000-06-30')) AS y_observed
FROM y LEFT JOIN a ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND o_totalprice / nullif(c_acctbal + 1000, 0) <= 400""")
def C01_abt_pd(t: Tables) -> DataFrame:
    """Decided orders with their target, application and financial blocks; implausible ones are left out."""
    sums = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("collaterals"), F.round(F.sum("l_extendedprice"), 2).alias("value"), F.bool_or(c("l_returnflag") == "R").alias("liquid"))
    block = R.prefix_block(sums, "app_", ["l_orderkey"])
    finance = t.customer.select("c_custkey", c("c_acctbal").alias("fin_balance"))
    rows = J.star_join(targets(t).where("o_orderstatus <> 'P'"), [(block, "o_orderkey", "l_orderkey"), (finance, "o_custkey", "c_custkey")]).where(L.safe_ratio("o_totalprice", c("fin_balance") + 1000, None) <= 400)
    return rows.select(c("o_orderkey").alias("application_id"), c("day").cast("string").alias("day"), K.split_at("day", "1999-06-30").alias("split"), c("o_totalprice").alias("app_limit"), "app_collaterals", "app_value", "app_liquid", "fin_balance", "y", "y_censored", c("y_age").cast("long").alias("y_age"), c("y_observed").cast("long").alias("y_observed"))


@query("SELECT o_orderkey AS application_id, o_totalprice AS app_limit, NULL::BIGINT AS app_collaterals, c_acctbal AS fin_balance FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def C02_abt_rejected(t: Tables) -> DataFrame:
    """Orders without items, in the columns of C01."""
    rest = t.orders.join(t.lineitem, c("l_orderkey") == c("o_orderkey"), "left_anti").join(t.customer, c("o_custkey") == c("c_custkey"), "left")
    return R.conform_to(rest.select(c("o_orderkey").alias("application_id"), c("o_totalprice").alias("app_limit"), c("c_acctbal").alias("fin_balance")), {"application_id": "bigint", "app_limit": "double", "app_collaterals": "bigint", "fin_balance": "double"})


@query("""WITH e AS (SELECT user_id AS k, min(ts)::DATE AS event_at FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY 1), p AS (SELECT user_id AS k, ts::DATE AS day, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1, 2)
SELECT p.k, day::VARCHAR AS day, n, max(errors) OVER w AS worst, CASE WHEN NOT (day + 7 > DATE '2024-01-30' AND NOT coalesce(event_at <= day + 7, false)) THEN coalesce(event_at <= day + 7, false)::INTEGER END AS y FROM p LEFT JOIN e USING (k) WHERE event_at IS NULL OR day < event_at WINDOW w AS (PARTITION BY p.k ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def C03_abt_ews(t: Tables) -> DataFrame:
    """Days of users before their event, with behaviour and whether it comes within a week."""
    from ledgerline.plans.windows import panel

    events = t.events.where("event_type = 'purchase' and value > 100").groupBy(c("user_id").alias("k")).agg(F.to_date(F.min("ts")).alias("event_at"))
    rows = panel(t).join(events, "k", "left").where("event_at is null or day < event_at")
    hit = F.coalesce(c("event_at") <= F.date_add("day", 7), F.lit(False))
    censored = (F.date_add("day", 7) > F.lit("2024-01-30").cast("date")) & ~hit
    worst = F.max("errors").over(W.partitionBy("k").orderBy("day").rowsBetween(-2, 0))
    return rows.select("k", c("day").cast("string").alias("day"), "n", worst.alias("worst"), F.when(~censored, hit.cast("int")).alias("y"))


@query(f"""WITH {_YEARS}, q AS (SELECT quantile_cont(year, 0.8) AS cut FROM y) SELECT l_orderkey, l_linenumber, l_partkey, year(l_shipdate) AS year, round(least(1, greatest(0, l_discount * 12)), 6) AS y_lgd, CASE WHEN year(l_shipdate) <= (SELECT quantile_cont(year(l_shipdate), 0.8) FROM lineitem WHERE l_returnflag = 'R') THEN 'train' ELSE 'test' END AS split FROM lineitem WHERE l_returnflag = 'R'""")
def C04_abt_lgd(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag = 'R'").withColumn("year", F.year("l_shipdate").cast("long"))
    cut = Q.row_of(rows, ["year"], [0.8]).select(c("year")[0].alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).select("l_orderkey", "l_linenumber", "l_partkey", "year", F.round(L.clip(c("l_discount") * 12, 0.0, 1.0), 6).alias("y_lgd"), F.when(c("year") <= c("cut"), "train").otherwise("test").alias("split"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate <= DATE '1999-06-30' THEN 'train' ELSE 'oot' END AS split FROM orders")
def C05_oot_split(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", K.split_at(F.to_date("o_orderdate"), "1999-06-30").alias("split"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN round(greatest(0, least(1, l_tax * 20)), 6) END AS lgd FROM lineitem")
def C06_lgd_realised(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(K.lgd_realised(c("l_tax") * 20, F.lit(1.0), c("l_returnflag") == "R"), 6).alias("lgd"))


@query(f"WITH {_APP} SELECT id, (CASE WHEN sales > 1e11 THEN debt / ebitda END) IS NULL AS ebitda_flag, coalesce(CASE WHEN id % 3 = 0 THEN pd END, 0) AS graf_rate FROM app")
def C07_semantic_missing(t: Tables) -> DataFrame:
    rows = applications(t).select("id", F.when(c("sales") > 1e11, c("debt") / c("ebitda")).alias("d"), F.when(c("id") % 3 == 0, c("pd")).alias("graf_rate"))
    return rows.select("id", c("d").isNull().alias("ebitda_flag"), "graf_rate").na.fill(0.0, ["graf_rate"])


@query("SELECT name, CASE WHEN name LIKE 'fin_%' THEN 'financial' WHEN name LIKE 'app_%' THEN 'application' ELSE 'target' END AS block, n, nulls FROM (SELECT 'fin_balance' AS name, count(c_acctbal) AS n, 0.0 AS nulls FROM customer UNION ALL SELECT 'app_nation', count(c_nationkey), 0.0 FROM customer UNION ALL SELECT 'y_neg', count(CASE WHEN c_acctbal < 0 THEN 1 END), round(avg(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE 1.0 END), 6) FROM customer)")
def C08_data_dictionary(t: Tables) -> DataFrame:
    rows = t.customer.select(c("c_acctbal").alias("fin_balance"), c("c_nationkey").alias("app_nation"), F.when(c("c_acctbal") < 0, 1).alias("y_neg"))
    block = F.when(c("name").startswith("fin_"), "financial").when(c("name").startswith("app_"), "application").otherwise("target")
    return A.profile(rows, rows.columns).select("name", block.alias("block"), "n", "nulls")


@query(f"""WITH {_APP} SELECT id, round(debt / equity, 6) AS der_interest, round(liabilities / equity, 6) AS der_total, round(CASE WHEN ebitda > 0 THEN debt / ebitda END, 6) AS debt_to_ebitda, round(CASE WHEN interest > 0 THEN ebitda / interest END, 6) AS icr, round(ebitda / sales, 6) AS ebitda_margin,
round(net_income / sales, 6) AS net_margin, round(net_income / equity, 6) AS roe, round(net_income / assets, 6) AS roa, CASE WHEN NOT interest > 0 THEN 'interest cover undefined' END AS note FROM app""")
def C09_ratio_tool(t: Tables) -> DataFrame:
    found = K.ratios("sales", "ebitda", "debt", "equity", "interest", "net_income", "assets", "liabilities")
    return applications(t).select("id", found.pop("note").alias("note"), *rounded(found))


@query(f"WITH {_APP} SELECT id, round(pay / 1e6, 7) AS pay, round(pay * 12 / 1e6, 7) AS per_year FROM gr")
def C10_annuity(t: Tables) -> DataFrame:
    return graded(t).select("id", F.round(c("pay") / 1e6, 7).alias("pay"), F.round(c("pay") * 12 / 1e6, 7).alias("per_year"))


@query(f"WITH {_APP} SELECT id, round(ebitda / (pay * 12 + interest), 6) AS dscr, ebitda / (pay * 12 + interest) >= 1.25 AS passed FROM gr")
def C11_dscr(t: Tables) -> DataFrame:
    found = K.dscr("ebitda", c("pay") * 12, "interest")
    return graded(t).select("id", F.round(found, 6).alias("dscr"), (found >= K.DSCR_MIN).alias("passed"))


_REC = _case(K.RECOVERY).format(c="kind")


@query(f"WITH {_APP} SELECT id, round(1 - {_REC} * least(collateral / asked, 1), 6) AS lgd, round(least(0.9, greatest(0.05, 1 - {_REC} * least(collateral / asked, 1))), 6) AS bounded FROM app")
def C12_lgd_collateral(t: Tables) -> DataFrame:
    found = K.lgd_collateral("kind", "collateral", "asked")
    return applications(t).select("id", F.round(found, 6).alias("lgd"), F.round(L.clip(found, 0.05, 0.90), 6).alias("bounded"))


_COV = _case(K.COVERAGE_MIN).format(c="grade")


@query(f"WITH {_APP} SELECT id, round(collateral / asked, 6) AS coverage, round(collateral / asked, 9) >= {_COV} AS passed, round(greatest({_COV} - collateral / asked, 0), 6) AS short FROM gr")
def C13_coverage_gate(t: Tables) -> DataFrame:
    least, coverage = L.lookup("grade", K.COVERAGE_MIN), c("collateral") / c("asked")
    return graded(t).select("id", F.round(coverage, 6).alias("coverage"), (F.round(coverage, 9) >= least).alias("passed"), F.round(F.greatest(least - coverage, F.lit(0.0)), 6).alias("short"))


@query(f"WITH {_APP} SELECT id, round(pd * lgd * asked, 2) AS loss, round(pd * lgd, 8) AS rate FROM app")
def C14_expected_loss(t: Tables) -> DataFrame:
    return applications(t).select("id", F.round(c("pd") * c("lgd") * c("asked"), 2).alias("loss"), F.round(c("pd") * c("lgd"), 8).alias("rate"))


@query(f"WITH {_APP}, r AS (SELECT id, 0.0475 + 0.0060 + pd * lgd + 0.0225 AS raw FROM app) SELECT id, round(raw, 8) AS raw, round(least(0.16, greatest(0.07, raw)), 8) AS pricing, raw < 0.07 OR raw > 0.16 AS at_bound FROM r")
def C15_risk_pricing(t: Tables) -> DataFrame:
    found = K.pricing("pd", "lgd")
    return applications(t).select("id", F.round(found["raw"], 8).alias("raw"), F.round(found["pricing"], 8).alias("pricing"), found["at_bound"].alias("at_bound"))


@query(f"WITH {_APP} SELECT id, grade FROM gr")
def C16_grade_from_pd(t: Tables) -> DataFrame:
    return graded(t).select("id", "grade")


@query(f"WITH {_APP} SELECT id, concat_ws(',', CASE WHEN NOT sales BETWEEN 30e9 AND 300e9 THEN 'sales' END, CASE WHEN NOT asked BETWEEN 10e9 AND 150e9 THEN 'limit' END) AS fails FROM app")
def C17_segment_gate(t: Tables) -> DataFrame:
    return applications(t).select("id", F.array_join(K.segment_fails(sales="sales", limit="asked"), ",").alias("fails"))


@query(f"WITH {_APP} SELECT id, round(exposure + asked, 2) AS after, 750e9 - exposure - asked >= 0 AS passed, round(greatest(750e9 - exposure, 0), 2) AS fits FROM app")
def C18_lending_limit_gate(t: Tables) -> DataFrame:
    return applications(t).select("id", F.round(c("exposure") + c("asked"), 2).alias("after"), (K.GROUP_LIMIT - c("exposure") - c("asked") >= 0).alias("passed"), F.round(F.greatest(K.GROUP_LIMIT - c("exposure"), F.lit(0.0)), 2).alias("fits"))


_DER, _ICR, _DSC = (_case({g: v[i] for g, v in K.COVENANTS.items()}).format(c="grade") for i in range(3))


@query(f"""WITH {_APP}, x AS (SELECT *, CASE WHEN id % 4 <> 0 THEN liabilities / equity END AS der_t, debt / equity AS der_i, ebitda / (pay * 12) AS d, CASE WHEN interest > 0 THEN ebitda / interest END AS i FROM gr)
SELECT id, CASE WHEN der_t IS NOT NULL THEN 'total' ELSE 'interest' END AS basis, concat_ws(',', CASE WHEN coalesce(der_t, der_i) > {_DER} THEN 'der' END, CASE WHEN d < {_DSC} THEN 'dscr' END, CASE WHEN coalesce(i < {_ICR}, true) THEN 'icr' END) AS violated FROM x""")
def C19_covenant_gate(t: Tables) -> DataFrame:
    rows = graded(t).withColumns({"der_t": F.when(c("id") % 4 != 0, c("liabilities") / c("equity")), "der_i": c("debt") / c("equity"), "d": c("ebitda") / (c("pay") * 12), "i": F.when(c("interest") > 0, c("ebitda") / c("interest"))})
    found = K.covenant_fails("grade", "der_t", "der_i", "d", "i")
    return rows.select("id", found["basis"].alias("basis"), F.array_join(found["violated"], ",").alias("violated"))


@query(f"WITH {_APP} SELECT id, CASE WHEN grade IN ('B', 'CCC') THEN 'central' WHEN asked <= 25e9 THEN 'regional' WHEN asked <= 75e9 THEN 'commercial' ELSE 'central' END AS committee FROM gr")
def C20_authority(t: Tables) -> DataFrame:
    return graded(t).select("id", K.authority("asked", "grade").alias("committee"))


@query(f"WITH {_APP} SELECT id, nullif(concat_ws(',', CASE WHEN coalesce(sales <= 2e10, true) THEN 'sales' END, CASE WHEN coalesce(rate >= 0.14, true) THEN 'rate' END), '') AS error FROM app")
def C21_input_guard(t: Tables) -> DataFrame:
    return applications(t).select("id", K.guard(sales=c("sales") <= 2e10, rate=c("rate") >= 0.14).alias("error"))


_LIMIT = f"""lim AS (SELECT *, {_case(K.BAND_CAPS).format(c='band')} AS cap2, greatest(750e9 - exposure, 0) AS cap3, CASE WHEN collateral > 0 THEN collateral / 1.25 ELSE least(asked, 10e9) END AS cap4,
 CASE WHEN revolving THEN ebitda * 0.75 / 15 / (rate / 12) ELSE ebitda * 0.75 / 15 * (1 - pow(1 + rate / 12, -months)) / (rate / 12) END AS cap1 FROM gr), rec AS (SELECT *, greatest(floor(least(asked, cap1, cap2, cap3, cap4) / 1e9) * 1e9, 0) AS lim FROM lim)"""


def recommended(t: Tables) -> DataFrame:
    rows = graded(t)
    found = K.limit_recommendation("asked", "ebitda", "months", "rate", c("revolving"), "band", "exposure", "collateral")
    return rows.withColumns(found)


@query(f"WITH {_APP}, {_LIMIT} SELECT id, lim AS \"limit\", CASE WHEN lim < asked THEN CASE least(cap1, cap2, cap3, cap4) WHEN cap1 THEN 'cash flow' WHEN cap2 THEN 'band' WHEN cap3 THEN 'group' ELSE 'collateral' END END AS bound_by FROM rec")
def C22_limit_recommendation(t: Tables) -> DataFrame:
    return recommended(t).select("id", "limit", "bound_by")


_GATE = f"""gate AS (SELECT *, CASE WHEN sales BETWEEN 30e9 AND 300e9 AND asked BETWEEN 10e9 AND 150e9 THEN 'pass' ELSE 'adjust' END AS segment, CASE WHEN lim > 0 THEN 'pass' ELSE 'adjust' END AS committee, CASE WHEN exposure / 750e9 < 0.85 THEN 'pass' ELSE 'adjust' END AS grp,
 CASE WHEN lim > 0 AND collateral / lim >= {_COV} THEN 'pass' ELSE 'adjust' END AS cover, CASE WHEN entities >= 3 THEN 'review' ELSE 'pass' END AS linked FROM rec),
ov AS (SELECT *, CASE WHEN 'adjust' IN (segment, committee, grp, cover, linked) THEN 'adjust' WHEN linked = 'review' THEN 'review' ELSE 'pass' END AS overall FROM gate)"""


def gated(t: Tables) -> DataFrame:
    ok = lambda x, other="adjust": F.when(x, "pass").otherwise(other)
    rows = recommended(t)
    aspects = {"segment": ok(F.size(K.segment_fails(sales="sales", limit="asked")) == 0), "committee": ok(c("limit") > 0), "grp": ok(c("exposure") / K.GROUP_LIMIT < 0.85),
               "cover": ok((c("limit") > 0) & (c("collateral") / L.null_if_zero("limit") >= L.lookup("grade", K.COVERAGE_MIN))), "linked": ok(c("entities") < 3, "review")}
    return rows.withColumns(aspects).withColumn("overall", K.policy_gate(**{n: c(n) for n in aspects})["overall"])


@query(f"WITH {_APP}, {_LIMIT}, {_GATE} SELECT id, segment, committee, grp, cover, linked, overall FROM ov")
def C23_policy_gate(t: Tables) -> DataFrame:
    return gated(t).select("id", "segment", "committee", "grp", "cover", "linked", "overall")


@query(f"WITH {_APP}, {_LIMIT}, {_GATE} SELECT id, CASE WHEN lim <= 0 OR band = 'very high' THEN 'reject' WHEN overall = 'adjust' THEN 'adjust' WHEN band = 'high' OR ebitda / (pay * 12) < 1.25 OR overall = 'review' THEN 'conditional' ELSE 'approve' END AS decision FROM ov")
def C24_decision(t: Tables) -> DataFrame:
    return gated(t).select("id", K.decision("limit", "band", "overall", c("ebitda") / (c("pay") * 12)).alias("decision"))


@query(f"""WITH {_APP}, s AS (SELECT id, greatest(-0.6, least(0.6, 0.60 * (liabilities / equity - 1.8))) AS a, greatest(-0.6, least(0.6, 1.9 * (asked / sales - 0.35))) AS b, greatest(-0.6, least(0.6, 3.1 * (pd - 0.05))) AS e FROM app)
SELECT id, round(least(0.6, greatest(0.0015, 1 / (1 + exp(-(-3.05 + a + b + e))))), 8) AS pd, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(e) THEN 'der' WHEN abs(b) >= abs(e) THEN 'limit' ELSE 'neighbour' END AS first_reason FROM s""")
def C25_scorecard(t: Tables) -> DataFrame:
    found = K.scorecard({"der": (c("liabilities") / c("equity"), 0.60, 1.8), "limit": (c("asked") / c("sales"), 1.90, 0.35), "neighbour": (c("pd"), 3.10, 0.05)})
    return applications(t).select("id", F.round(found["pd"], 8).alias("pd"), found["reasons"][0].alias("first_reason"))


@query(f"WITH {_APP} SELECT id, share, m AS months, round(asked * share * (rate / 12) / (1 - pow(1 + rate / 12, -m)) / 1e6, 4) AS pay FROM app, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) s(share), (VALUES (12), (36)) n(m)")
def C26_scenario_grid(t: Tables) -> DataFrame:
    grid = applications(t).select("id", "asked", "rate", F.explode(F.array(F.lit(0.5), F.lit(1.0))).alias("share")).select("*", F.explode(F.array(F.lit(12), F.lit(36))).alias("months"))
    return grid.select("id", "share", "months", F.round(K.instalment(c("asked") * c("share"), "months", "rate") / 1e6, 4).alias("pay"))


@query(f"WITH {_APP} SELECT id, band, CASE WHEN lgd <= 0.25 THEN 'low' WHEN lgd <= 0.5 THEN 'medium' WHEN lgd <= 0.75 THEN 'high' ELSE 'very high' END AS lgd_band FROM gr")
def C27_risk_band(t: Tables) -> DataFrame:
    return graded(t).select("id", "band", K.band("lgd", (0.25, 0.5, 0.75)).alias("lgd_band"))


@query(f"WITH {_YEARS} SELECT k, year, round((total - lag(total) OVER w) / nullif(abs(lag(total) OVER w), 0), 6) AS yoy, round(total - lag(total, 2) OVER w, 2) AS d3 FROM y WINDOW w AS (PARTITION BY k ORDER BY year)")
def C28_trend_features(t: Tables) -> DataFrame:
    w = W.partitionBy("k").orderBy("year")
    before = F.lag("total").over(w)
    mapped = years(t).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("year", "total"))).alias("m")).select("k", F.explode("m").alias("year", "total"))
    return mapped.select("k", "year", F.round((c("total") - before) / L.null_if_zero(F.abs(before)), 6).alias("yoy"), F.round(c("total") - F.lag("total", 2).over(w), 2).alias("d3"))


@query(f"WITH {_APP} SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'statements' END, CASE WHEN kind = 'land' THEN 'valuation' END, CASE WHEN kind = 'machinery' THEN 'invoices' END, CASE WHEN kind IN ('inventory', 'receivables') THEN 'ageing' END, CASE WHEN entities >= 3 THEN 'ownership' END, 'visit') AS missing FROM app")
def C29_missing_documents(t: Tables) -> DataFrame:
    found = L.names_where(statements=c("id") % 2 == 0, valuation=c("kind") == "land", invoices=c("kind") == "machinery", ageing=c("kind").isin("inventory", "receivables"), ownership=c("entities") >= 3, visit=F.lit(True))
    return applications(t).select("id", F.array_join(found, ",").alias("missing"))


@query("SELECT o_orderkey, last_day(m)::VARCHAR AS month FROM (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + INTERVAL 6 MONTH)::DATE AS b, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL 6 MONTH), INTERVAL 1 MONTH)) AS m FROM orders) WHERE last_day(m) BETWEEN a AND b")
def C30_monthly_observation_grid(t: Tables) -> DataFrame:
    start = F.to_date("o_orderdate")
    rows = t.orders.select("o_orderkey", start.alias("a"), F.add_months(start, 6).alias("b"))
    return K.month_grid(rows, "a", "b", "month").select("o_orderkey", c("month").cast("string").alias("month"))


_CT = {n: f"coalesce({_case(v).format(c='grade')}, {list(v.values())[-1]})" for n, v in K.COVENANT_TABLE.items()}


@query(f"WITH {_APP} SELECT id, 'der_max' AS kind, ({_CT['der_max']})::DOUBLE AS bound, liabilities / equity > {_CT['der_max']} AS breach FROM gr UNION ALL SELECT id, 'icr_min', ({_CT['icr_min']})::DOUBLE, coalesce(ebitda / nullif(interest, 0) < {_CT['icr_min']}, false) FROM gr")
def C31_covenant_thresholds(t: Tables) -> DataFrame:
    value = {"der_max": c("liabilities") / c("equity"), "icr_min": c("ebitda") / L.null_if_zero("interest")}
    rows = []
    for kind, table in K.COVENANT_TABLE.items():
        bound = L.map_lookup("grade", table, list(table.values())[-1])
        breach = value[kind] > bound if kind.endswith("max") else value[kind] < bound
        rows.append(F.struct(F.lit(kind).alias("kind"), bound.alias("bound"), F.coalesce(breach, F.lit(False)).alias("breach")))
    return graded(t).select("id", F.inline(F.array(*rows)))


@query(f"WITH {_APP} SELECT id, CASE WHEN dpd <= 0 THEN 1 WHEN dpd <= 90 THEN 2 WHEN dpd <= 120 THEN 3 WHEN dpd <= 180 THEN 4 ELSE 5 END AS grade FROM app")
def C32_grade_from_dpd(t: Tables) -> DataFrame:
    return applications(t).select("id", K.grade_from_dpd("dpd").alias("grade"))


@query("""WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS score FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT c_custkey, score, CASE WHEN score <= 40 THEN 'low' WHEN score <= 100 THEN 'medium' WHEN score IS NOT NULL THEN 'high' END AS band, coalesce(score > 100, false) AS alarm, score IS NULL AS uncovered FROM customer LEFT JOIN l ON user_id = c_custkey""")
def C33_linked_early_warning(t: Tables) -> DataFrame:
    """The last reading of each borrower before a day, its band and alarm; borrowers without one are uncovered."""
    last = t.events.where(c("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("score"))
    rows = t.customer.join(last, c("user_id") == c("c_custkey"), "left")
    return rows.select("c_custkey", "score", K.band("score", (40, 100), ("low", "medium", "high")).alias("band"), F.coalesce(c("score") > 100, F.lit(False)).alias("alarm"), c("score").isNull().alias("uncovered"))


@query(f"WITH {_APP}, m AS (SELECT median(debt / asked) AS a, median(ebitda / sales) AS b, median(pd) AS p FROM app) SELECT id, round(coalesce(CASE WHEN id % 3 = 0 THEN pd END, p), 8) AS pd, round(coalesce(CASE WHEN id % 2 = 0 THEN debt / asked END, a), 8) AS leverage, 'pd:' || CASE WHEN id % 3 = 0 THEN 'document' ELSE 'portfolio' END || ',leverage:' || CASE WHEN id % 2 = 0 THEN 'document' ELSE 'portfolio' END AS origins FROM app, m")
def C34_fill_from_portfolio(t: Tables) -> DataFrame:
    rows = applications(t)
    medians = Q.medians(rows, {"_p": "pd", "_a": c("debt") / c("asked")}, [], None)
    found = K.fill_with({"pd": F.when(c("id") % 3 == 0, c("pd")), "leverage": F.when(c("id") % 2 == 0, c("debt") / c("asked"))}, {"pd": c("_p"), "leverage": c("_a")})
    return rows.crossJoin(F.broadcast(medians)).select("id", F.round(found["pd"], 8).alias("pd"), F.round(found["leverage"], 8).alias("leverage"), found["origins"].alias("origins"))
