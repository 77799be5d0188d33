"""Queries over models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline import functions as L
from ledgerline.operators import aggregates as A
from ledgerline.operators import evaluate as E
from ledgerline.operators import features as N
from ledgerline.operators import graph as G
from ledgerline.operators import model as M
from ledgerline.operators import quantiles as Q
from ledgerline.operators import relational as J
from ledgerline.operators import rows as R
from ledgerline.operators import windows as V
from ledgerline.plans import Register, Tables
from ledgerline.plans.aggregates import _LABELLED, _RATES, labelled_orders, payments

query = Register()
c = F.col
_SC = "sc AS (SELECT doc_id, quality AS y, round(n_chars / (n_chars + 2000.0), 3) AS s, (doc_id * 7919 % 1000) / 1000.0 AS s2, lang FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"
_AUC = "(sum(CASE WHEN y = 1 THEN r END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END))"
_RANK = "(rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0)"
_CUM = f"{_SC}, ds AS (SELECT s, sum(y) AS e, count(*) AS n FROM sc GROUP BY 1), cu AS (SELECT s, e, n, sum(e) OVER w AS ce, sum(n) OVER w AS cn, sum(e) OVER () AS te, sum(n) OVER () AS tn FROM ds WINDOW w AS (ORDER BY s DESC))"


def scored(t: Tables) -> DataFrame:
    """Labelled documents with a score from their length and another from their number."""
    rows = t.labels.where("quality is not null").join(t.documents, "doc_id")
    return rows.select("doc_id", c("quality").alias("y"), F.round(c("n_chars") / (c("n_chars") + 2000.0), 3).alias("s"), ((c("doc_id") * 7919 % 1000) / 1000.0).alias("s2"), "lang")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(x, digits).alias(x) if kind == "double" else c(x) for x, kind in df.dtypes])


FEATURES = ["o_totalprice", "c_acctbal", "c_nationkey"]


def training(t: Tables) -> DataFrame:
    return labelled_orders(t).select("o_orderkey", "o_custkey", *[c(x).cast("double").alias(x) for x in FEATURES], "o_orderpriority", "y")


@query()
def M01_preprocess(t: Tables) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = M.with_indicators(training(t), FEATURES)
    return M.preprocess(FEATURES, ["o_orderpriority"]).fit(rows).transform(rows).select("o_orderkey", vector_to_array("features").alias("features"))


@query()
def M02_fit_classifiers(t: Tables) -> DataFrame:
    rows = training(t)
    parts = [M.score(M.fit(rows, "y", FEATURES, ["o_orderpriority"], kind), rows, FEATURES).select("o_orderkey", F.lit(kind).alias("model"), "score") for kind in ("logistic", "boosted", "forest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def losses(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", c("l_quantity"), c("l_tax"), c("l_extendedprice").alias("price"), (c("l_discount") * 10).alias("lgd"))


@query()
def M03_fit_lgd(t: Tables) -> DataFrame:
    rows, numeric = losses(t), ["l_quantity", "l_tax", "price"]
    predicted = M.fit_regression(rows, "lgd", numeric).transform(M.with_indicators(rows, numeric))
    mean = rows.agg(F.avg("lgd").alias("baseline"))
    return predicted.select("l_orderkey", "l_linenumber", "l_partkey", "lgd", L.clip("prediction", 0.0, 1.0).alias("predicted")).crossJoin(F.broadcast(mean))


@query(f"WITH {_LABELLED}, s AS (SELECT o_custkey, coalesce(sum(y), 0) AS e FROM lab GROUP BY 1), r AS (SELECT o_custkey, row_number() OVER (ORDER BY e DESC, md5(o_custkey::VARCHAR), o_custkey) - 1 AS i FROM s) SELECT o_custkey, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INTEGER AS fold FROM r")
def M04_stratified_group_folds(t: Tables) -> DataFrame:
    return E.group_folds(training(t), "o_custkey", "y", 5)


@query()
def M05_oof_predictions(t: Tables) -> DataFrame:
    rows = training(t).where("y is not null")
    return M.out_of_fold(rows, E.group_folds(rows, "o_custkey", "y", 5), "o_custkey", "y", FEATURES, 5).select("o_orderkey", "fold", "y", "score")


@query()
def M06_platt_calibration(t: Tables) -> DataFrame:
    return M.platt(scored(t), "s", "y").select("doc_id", "s", "calibrated")


@query(f"WITH {_SC}, rk AS (SELECT y, {_RANK.format(s='s')} AS r FROM sc) SELECT round({_AUC}, 6) AS auc, round(2 * ({_AUC}) - 1, 6) AS gini FROM rk")
def M07_roc_auc(t: Tables) -> DataFrame:
    return rounded(E.roc_auc(scored(t), "s", "y"))


@query(f"WITH {_CUM} SELECT round(max(abs(ce / te - (cn - ce) / (tn - te))), 6) AS ks FROM cu")
def M08_ks_statistic(t: Tables) -> DataFrame:
    return rounded(E.ks(scored(t), "s", "y"))


@query(f"WITH {_CUM} SELECT round(sum(e / te * ce / cn), 6) AS average_precision FROM cu")
def M09_average_precision(t: Tables) -> DataFrame:
    return rounded(E.average_precision(scored(t), "s", "y"))


@query(f"WITH {_SC}, p AS (SELECT y, s, greatest(1e-6, least(1 - 1e-6, s)) AS p FROM sc) SELECT round(avg((s - y) * (s - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM p")
def M10_brier_log_loss(t: Tables) -> DataFrame:
    return rounded(scored(t).agg(*E.losses("s", "y")))


_CONF = "count(CASE WHEN s >= th AND y = 1 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN s >= th AND y <> 1 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN s < th AND y <> 1 THEN 1 END)::DOUBLE AS tn, count(CASE WHEN s < th AND y = 1 THEN 1 END)::DOUBLE AS fn"


@query(f"""WITH {_SC}, x AS (SELECT {_CONF} FROM sc, (SELECT 0.3 AS th)), r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS rc, tn / nullif(tn + fp, 0) AS sp, tp + fp + tn + fn AS n FROM x)
SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round((rc + sp) / 2, 6) AS balanced, round(p, 6) AS precision, round(rc, 6) AS recall, round(sp, 6) AS specificity, round(tn / nullif(tn + fn, 0), 6) AS npv, round(2 * p * rc / (p + rc), 6) AS f1, round(5 * p * rc / (4 * p + rc), 6) AS f2,
round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr, round((tp + fp) / n, 6) AS alert_rate, round((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 6) AS mcc FROM r""")
def M11_confusion_metrics(t: Tables) -> DataFrame:
    return rounded(scored(t).agg(*[v.alias(n) for n, v in E.confusion(c("s"), c("y"), F.lit(0.3)).items()]))


@query(f"WITH {_CUM} SELECT s AS score, round(ce / cn, 6) AS precision, round(ce / te, 6) AS recall FROM cu WHERE ce / te >= 0.8 ORDER BY ce / cn DESC, s DESC LIMIT 1")
def M12_threshold_min_recall(t: Tables) -> DataFrame:
    return rounded(E.threshold_min_recall(scored(t), "s", "y", 0.80))


@query(f"WITH {_SC} SELECT round(quantile_cont(s::DOUBLE, 0.5), 6) AS q50, round(quantile_cont(s::DOUBLE, 0.8), 6) AS q80, round(quantile_cont(s::DOUBLE, 0.95), 6) AS q95 FROM sc")
def M13_risk_cutoffs(t: Tables) -> DataFrame:
    return rounded(Q.row_of(scored(t), ["s"], [0.5, 0.8, 0.95]).select(*[c("s")[i].alias(n) for i, n in enumerate(("q50", "q80", "q95"))]))


_BAND = "CASE WHEN s <= 0.3 THEN 'low' WHEN s <= 0.5 THEN 'middle' ELSE 'high' END"


def banded(t: Tables) -> DataFrame:
    return scored(t).withColumn("band", L.bin_fixed("s", (0.3, 0.5), ("low", "middle", "high")))


@query(f"WITH {_SC}, b AS (SELECT {_BAND} AS band, count(*) AS rows, sum(y)::BIGINT AS events, avg(y) AS rate, avg(s) AS mean, min(s) AS low, max(s) AS high FROM sc GROUP BY 1) SELECT band, rows, events, round(rate, 6) AS rate, round(mean, 6) AS mean, low, high, round(rows / sum(rows) OVER (), 6) AS share, round(events / sum(events) OVER (), 6) AS captured FROM b")
def M14_band_table(t: Tables) -> DataFrame:
    return rounded(E.band_table(banded(t), "band", "s", "y"))


@query(f"WITH {_SC}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS r, count(*) OVER () AS n, sum(y) OVER () AS e FROM sc), f AS (SELECT unnest([0.05, 0.1, 0.2]) AS fraction) SELECT fraction::DOUBLE AS fraction, round(sum(y) / any_value(e), 6) AS capture, round(sum(y) / count(*), 6) AS precision, round(sum(y) / count(*) / (any_value(e) / any_value(n)), 6) AS lift FROM r, f WHERE r <= ceil(n * fraction) GROUP BY 1")
def M15_capture_lift(t: Tables) -> DataFrame:
    return rounded(E.capture(scored(t), "s", "doc_id", "y", (0.05, 0.1, 0.2)))


@query()
def M16_bootstrap_ci(t: Tables) -> DataFrame:
    q = F.percentile("auc_s", [0.025, 0.5, 0.975])
    return E.resampled_auc(scored(t), ["s"], "y", size=250_000).agg(q.alias("q")).select(c("q")[0].alias("low"), c("q")[1].alias("middle"), c("q")[2].alias("high"))


@query()
def M17_paired_bootstrap_delta(t: Tables) -> DataFrame:
    d = E.resampled_auc(scored(t), ["s", "s2"], "y", size=250_000).withColumn("d", c("auc_s") - c("auc_s2"))
    return d.agg(F.percentile("d", [0.025, 0.975]).alias("q"), F.avg("d").alias("mean")).select(c("q")[0].alias("low"), c("q")[1].alias("high"), "mean")


_PSI = """e AS (SELECT o_totalprice AS v FROM orders WHERE o_orderdate < DATE '1998-01-01'), a AS (SELECT o_totalprice AS v FROM orders WHERE o_orderdate >= DATE '1998-01-01'), q AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM e),
be AS (SELECT len(list_filter(b, lambda x: x < v)) AS k, count(*) / (SELECT count(*) FROM e) AS s FROM e, q GROUP BY 1), ba AS (SELECT len(list_filter(b, lambda x: x < v)) AS k, count(*) / (SELECT count(*) FROM a) AS s FROM a, q GROUP BY 1)"""


@query(f"WITH {_PSI} SELECT round(sum((greatest(coalesce(ba.s, 0), 1e-4) - greatest(coalesce(be.s, 0), 1e-4)) * ln(greatest(coalesce(ba.s, 0), 1e-4) / greatest(coalesce(be.s, 0), 1e-4))), 8) AS psi FROM be FULL JOIN ba USING (k)")
def M18_psi(t: Tables) -> DataFrame:
    cut = F.lit("1998-01-01").cast("date")
    return rounded(E.psi(t.orders.where(c("o_orderdate") < cut), t.orders.where(c("o_orderdate") >= cut), "o_totalprice"), 8)


@query(f"WITH {_SC}, x AS (SELECT y, {_RANK.format(s='s')} AS r FROM sc WHERE lang = 'en'), z AS (SELECT y, {_RANK.format(s='s')} AS r FROM sc WHERE lang <> 'en'), a AS (SELECT {_AUC} AS a FROM x), b AS (SELECT {_AUC} AS b FROM z) SELECT round(a, 6) AS source, round(b, 6) AS gold, (a - 0.5) * (b - 0.5) > 0 AS same_direction FROM a, b")
def M19_signal_survival(t: Tables) -> DataFrame:
    one, two = (E.roc_auc(scored(t).where(f"lang {k} 'en'"), "s", "y").select(c("auc").alias(n)) for k, n in (("=", "source"), ("<>", "gold")))
    both = one.crossJoin(two)
    return rounded(both.withColumn("same_direction", (c("source") - 0.5) * (c("gold") - 0.5) > 0))


@query(f"WITH r AS (SELECT {_RANK.format(s='l_quantity')} AS a, {_RANK.format(s='l_extendedprice')} AS b, {_RANK.format(s='l_discount')} AS d FROM lineitem) SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(a, d), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(b, d), 6) FROM r")
def M20_spearman_matrix(t: Tables) -> DataFrame:
    return rounded(E.spearman(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "l_orderkey"))


DRIFT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _drift() -> str:
    """The two correlation matrices in SQL, and what they have in common."""
    pairs = [(x, y) for i, x in enumerate(DRIFT) for y in DRIFT[i + 1 :]]
    side = lambda name, where: f"{name} AS MATERIALIZED (SELECT {', '.join(f'{_RANK.format(s=x)} AS {x}' for x in DRIFT)} FROM lineitem WHERE {where})"
    rows = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, (SELECT corr({x}, {y}) FROM a) AS source, (SELECT corr({x}, {y}) FROM b) AS gold" for x, y in pairs)
    return f"WITH {side('a', chr(39).join(('l_returnflag = ', 'R', '')))}, {side('b', chr(39).join(('l_returnflag <> ', 'R', '')))}, m AS ({rows})"


@query(f"{_drift()} SELECT x, y, round(source, 6) AS source, round(gold, 6) AS gold, round(gold - source, 6) AS shift, sign(source) <> sign(gold) AS flipped, row_number() OVER (ORDER BY abs(gold - source) DESC, x, y) AS place FROM m")
def M20_matrix_shifts(t: Tables) -> DataFrame:
    """The rank correlations of returned and of other lines, pair by pair, the largest shift first."""
    return rounded(E.matrix_shifts(*_matrices(t)))


@query(f"{_drift()} SELECT round(corr(source, gold), 6) AS agreement, round(avg(abs(gold - source)), 6) AS mean_shift, count(CASE WHEN sign(source) <> sign(gold) THEN 1 END) AS flipped, count(*) AS pairs FROM m")
def M20_matrix_drift(t: Tables) -> DataFrame:
    """How far the two matrices agree."""
    return rounded(E.matrix_drift(*_matrices(t)))


def _matrices(t: Tables) -> tuple[DataFrame, DataFrame]:
    return E.spearman(t.lineitem.where("l_returnflag = 'R'"), DRIFT, "l_orderkey"), E.spearman(t.lineitem.where("l_returnflag <> 'R'"), DRIFT, "l_orderkey")


def customer_features(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    rows = t.customer.join(spent, c("o_custkey") == c("c_custkey")).select("c_custkey", "c_acctbal", "orders", "mean", "most", "c_mktsegment")
    return V.winsorize(rows, ["c_acctbal", "mean", "most"])


NUMERIC = ["c_acctbal", "orders", "mean", "most"]


@query()
def M21_kmeans_segments(t: Tables) -> DataFrame:
    return M.segments(customer_features(t), NUMERIC)[1].select("c_custkey", "cluster")


@query()
def M22_cluster_quality(t: Tables) -> DataFrame:
    """Silhouette, inertia, Calinski-Harabasz and Davies-Bouldin of the segments."""
    return M.cluster_indices(M.segments(customer_features(t), NUMERIC)[1])


@query()
def M21_segment_sweep(t: Tables) -> DataFrame:
    """The indices of two to eight segments over the same components."""
    return M.sweep(customer_features(t), NUMERIC, range(2, 9))


_GROUPS = "gr AS (SELECT c_mktsegment AS cluster, (EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_shipdate >= DATE '1995-01-01'))::INTEGER AS y, c_acctbal, c_nationkey FROM customer)"


def grouped_events(t: Tables) -> DataFrame:
    """Customers by segment, with whether they returned anything since 1995."""
    late = t.lineitem.where("l_returnflag = 'R' and l_shipdate >= date '1995-01-01'").join(t.orders, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("c_custkey")).distinct().withColumn("y", F.lit(1))
    return t.customer.join(late, "c_custkey", "left").select(c("c_mktsegment").alias("cluster"), F.coalesce("y", F.lit(0)).alias("y"), "c_acctbal", "c_nationkey")


@query(f"WITH {_GROUPS}, r AS (SELECT cluster, count(*) AS n, sum(y)::BIGINT AS events, avg(y) AS rate FROM gr GROUP BY 1), w AS (SELECT *, row_number() OVER (ORDER BY rate DESC, cluster) = 1 AS riskiest, sum(n) OVER () AS all_n, sum(events) OVER () AS all_e FROM r) SELECT cluster, n, events, round(rate, 6) AS rate, round(events / all_e, 6) AS captured, round(rate / (all_e / all_n), 6) AS lift, riskiest FROM w")
def M23_cluster_events(t: Tables) -> DataFrame:
    """Of each cluster its events, their rate, share and lift, and which one is the riskiest."""
    return rounded(E.cluster_events(grouped_events(t), "cluster", "y"))


@query(f"WITH {_GROUPS}, r AS (SELECT cluster, avg(y) AS rate FROM gr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), x AS (SELECT count(CASE WHEN gr.cluster = r.cluster AND y = 1 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN gr.cluster = r.cluster AND y = 0 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN gr.cluster <> r.cluster AND y = 0 THEN 1 END)::DOUBLE AS tn, count(CASE WHEN gr.cluster <> r.cluster AND y = 1 THEN 1 END)::DOUBLE AS fn FROM gr, r) SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM x")
def M23_cluster_confusion(t: Tables) -> DataFrame:
    """The riskiest cluster as a forecast of events."""
    rows = grouped_events(t)
    worst = E.cluster_events(rows, "cluster", "y").where("riskiest").select(c("cluster").alias("_worst"))
    hit = rows.crossJoin(F.broadcast(worst)).withColumn("_hit", (c("cluster") == c("_worst")).cast("double"))
    found = E.confusion(c("_hit"), c("y"), F.lit(0.5))
    return rounded(hit.agg(*[found[n].alias(n) for n in ("tp", "fp", "tn", "fn", "accuracy", "precision", "recall")]))


@query(f"WITH {_GROUPS}, l AS (SELECT cluster, 'c_acctbal' AS feature, c_acctbal AS v FROM gr UNION ALL SELECT cluster, 'c_nationkey', c_nationkey FROM gr) SELECT cluster, feature, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM l GROUP BY 1, 2")
def M24_cluster_means(t: Tables) -> DataFrame:
    """Mean and median of each feature by cluster."""
    long = grouped_events(t).select("cluster", F.expr("stack(2, 'c_acctbal', c_acctbal, 'c_nationkey', cast(c_nationkey as double)) as (feature, v)"))
    means = long.groupBy("cluster", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return rounded(means.join(Q.medians(long, {"median": c("v")}, ["cluster", "feature"]), ["cluster", "feature"]))


@query("""WITH x AS (SELECT o_orderstatus AS a, o_orderkey % 3 AS b FROM orders), ce AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), sa AS (SELECT sum(m * (m - 1) / 2) AS s, -sum(m * ln(m)) AS h FROM (SELECT a, sum(n) AS m FROM ce GROUP BY 1)), sb AS (SELECT sum(m * (m - 1) / 2) AS s, -sum(m * ln(m)) AS h FROM (SELECT b, sum(n) AS m FROM ce GROUP BY 1)),
al AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t, sum(n * ln(n)) AS j FROM ce) SELECT round((al.s - sa.s * sb.s / (t * (t - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (t * (t - 1) / 2)), 8) AS ari, round(2 * (j / t + sa.h / t + ln(t) + sb.h / t + ln(t) - ln(t)) / (sa.h / t + ln(t) + sb.h / t + ln(t)), 8) AS nmi FROM al, sa, sb""")
def M23_cluster_validation(t: Tables) -> DataFrame:
    return rounded(E.contingency(t.orders.select(c("o_orderstatus").alias("a"), (c("o_orderkey") % 3).alias("b")), "a", "b"), 8)


@query("SELECT 'p_retailprice' AS feature, round(median(p_retailprice) FILTER (p_type = 'SMALL'), 6) AS small, round(median(p_retailprice) FILTER (p_type = 'LARGE'), 6) AS large FROM part UNION ALL SELECT 'p_size', round(median(p_size) FILTER (p_type = 'SMALL'), 6), round(median(p_size) FILTER (p_type = 'LARGE'), 6) FROM part")
def M24_cluster_profile(t: Tables) -> DataFrame:
    long = t.part.select("p_type", F.expr("stack(2, 'p_retailprice', p_retailprice, 'p_size', cast(p_size as double)) as (feature, value)"))
    return Q.medians(long, {x.lower(): F.when(c("p_type") == x, c("value")) for x in ("SMALL", "LARGE")}, ["feature"])


@query("""WITH ce AS (SELECT p_type, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1), d AS (SELECT p_partkey, ce.p_type, sqrt((p_retailprice - a) * (p_retailprice - a) + (p_size - b) * (p_size - b)) AS d FROM part, ce), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, p_type) AS r FROM d) SELECT p_partkey, p_type AS nearest, round(d, 6) AS distance FROM r WHERE r = 1""")
def M25_cluster_position(t: Tables) -> DataFrame:
    """The nearest centre, the centres (one a type) being one row of an array."""
    centres = t.part.groupBy("p_type").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b")).agg(F.collect_list(F.struct("p_type", "a", "b")).alias("centres"))
    far = F.array_min(F.transform("centres", lambda x: F.struct(F.sqrt((c("p_retailprice") - x["a"]) * (c("p_retailprice") - x["a"]) + (c("p_size") - x["b"]) * (c("p_size") - x["b"])).alias("d"), x["p_type"].alias("n"))))
    return t.part.crossJoin(F.broadcast(centres)).withColumn("f", far).select("p_partkey", c("f.n").alias("nearest"), F.round("f.d", 6).alias("distance"))


@query("WITH e AS (SELECT l_discount AS a, l_tax AS p FROM lineitem) SELECT round(avg(abs(p - a)), 8) AS mae, round(avg((p - a) * (p - a)), 8) AS mse, round(sqrt(avg((p - a) * (p - a))), 8) AS rmse, round(1 - avg((p - a) * (p - a)) / var_pop(a), 6) AS r2, round(avg(p - a), 8) AS bias, round(quantile_cont(abs(p - a), 0.9), 8) AS p90 FROM e")
def M26_regression_metrics(t: Tables) -> DataFrame:
    row = E.regression(t.lineitem, c("l_discount"), c("l_tax"))
    return row.select(*[F.round(x, 6 if x == "r2" else 8).alias(x) for x in row.columns])


@query()
def M27_permutation_importance(t: Tables) -> DataFrame:
    """How much the AUC of a score falls when it is dealt out anew among the rows, three times."""
    base = R.add_row_id(scored(t), "i", ["doc_id"])
    full = E.roc_auc(base, "s", "y").select(c("auc").alias("full"))
    parts = []
    for k in range(3):
        mixed = R.add_row_id(base.select(F.xxhash64("doc_id", F.lit(k)).alias("o"), c("s").alias("m"), "doc_id"), "i", ["o", "doc_id"]).select("i", "m")
        parts.append(E.roc_auc(base.join(mixed, "i"), "m", "y").select(F.lit(k).alias("repeat"), "auc"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).crossJoin(full).select("repeat", (c("full") - c("auc")).alias("drop"))


@query()
def M28_ablation_compare(t: Tables) -> DataFrame:
    """One row for the folds and one for the time after them: AUC without and with the graph block, and their difference with an interval."""
    block = payments(t).groupBy(c("src").alias("o_custkey"), "dst").agg(F.sum("amount").alias("w")).groupBy("o_custkey").agg(F.count("*").cast("double").alias("partners"), A.hhi("w").alias("concentration"))
    rows = labelled_orders(t).select("o_orderkey", "o_custkey", *[c(x).cast("double").alias(x) for x in FEATURES], (c("o_orderdate") < F.lit("1998-01-01").cast("date")).alias("early"), "y")
    rows = G.cut(rows.where("y is not null").join(block, "o_custkey", "left"))
    early, late = rows.where("early"), rows.where("not early")
    folds = G.cut(E.group_folds(early, "o_custkey", "y", 5))
    parts = []
    for part in ("folds", "later"):
        both = None
        for name, features in (("without", FEATURES), ("with_graph", [*FEATURES, "partners", "concentration"])):
            own = M.out_of_fold(early, folds, "o_custkey", "y", features, 5) if part == "folds" else M.score(M.fit(early, "y", features), late, features)
            own = own.select("o_orderkey", "y", c("score").alias(name))
            both = own if both is None else both.join(own.drop("y"), "o_orderkey")
        both = G.cut(both)  # plain numbers: no model goes into the evaluation's plan
        d = E.resampled_auc(both, ["without", "with_graph"], "y", size=250_000).agg(F.percentile(c("auc_with_graph") - c("auc_without"), [0.025, 0.975]).alias("q"))
        auc = [E.roc_auc(both, n, "y").select(c("auc").alias(f"auc_{n}")) for n in ("without", "with_graph")]
        parts.append(auc[0].crossJoin(auc[1]).crossJoin(d).select(F.lit(part).alias("part"), "auc_without", "auc_with_graph", (c("auc_with_graph") - c("auc_without")).alias("delta"), c("q")[0].alias("low"), c("q")[1].alias("high")))
    return parts[0].unionByName(parts[1])


@query(f"WITH {_LABELLED} SELECT year(o_orderdate) AS cohort, CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'train' ELSE 'oot' END AS split, {_RATES} FROM lab GROUP BY 1, 2")
def M29_population_audit(t: Tables) -> DataFrame:
    rows = labelled_orders(t).withColumns({"cohort": F.year("o_orderdate").cast("long"), "split": F.when(c("o_orderdate") < F.lit("1999-01-01").cast("date"), "train").otherwise("oot")})
    return A.bad_rates(rows, ["cohort", "split"], "y")


@query(f"WITH {_SC}, b AS (SELECT *, greatest(1, least(5, ceil(round(row_number() OVER (ORDER BY s, doc_id) / count(*) OVER () * 5, 9))))::BIGINT AS bucket FROM sc) SELECT bucket, count(*) AS n, round(avg(y), 6) AS rate FROM b GROUP BY 1")
def M30_bucket_event_rates(t: Tables) -> DataFrame:
    ranked = V.percent_rank_first(scored(t), "s", "doc_id", "p").withColumn("bucket", V.quantile_bucket(c("p"), 5))
    return ranked.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@query("WITH f AS (SELECT o_orderkey, ((o_orderstatus <> 'P')::INTEGER + (o_totalprice > 100000)::INTEGER + (o_orderkey % 3 <> 0)::INTEGER + 1) / 4 AS share FROM orders) SELECT o_orderkey, share, CASE WHEN share >= 0.75 THEN 'high' WHEN share >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM f")
def M31_input_completeness(t: Tables) -> DataFrame:
    there = F.array(F.when(c("o_orderstatus") != "P", 1), F.when(c("o_totalprice") > 100000, 1), F.when(c("o_orderkey") % 3 != 0, 1), F.lit(1))
    share = F.size(F.filter(there, lambda x: x.isNotNull())) / F.size(there)
    return t.orders.select("o_orderkey", share.alias("share"), F.when(share >= 0.75, "high").when(share >= 0.5, "medium").otherwise("low").alias("level"))


@query("WITH b AS (SELECT quantile_cont(p_retailprice, [0.05, 0.95]) AS q1, quantile_cont(p_size, [0.05, 0.95]) AS q2 FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice < q1[1] OR p_retailprice > q1[2] THEN 'p_retailprice' END, CASE WHEN p_size < q2[1] OR p_size > q2[2] THEN 'p_size' END) AS warnings FROM part, b")
def M32_reference_warnings(t: Tables) -> DataFrame:
    bounds = Q.row_of(t.part, {"a": "p_retailprice", "b": "p_size"}, [0.05, 0.95])
    out = L.names_where(p_retailprice=~c("p_retailprice").between(c("a")[0], c("a")[1]), p_size=~c("p_size").between(c("b")[0], c("b")[1]))
    return t.part.crossJoin(F.broadcast(bounds)).select("p_partkey", F.array_join(F.slice(out, 1, 10), ",").alias("warnings"))


@query("SELECT 'o_totalprice' AS name, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS p50, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high FROM orders")
def M33_reference_stats(t: Tables) -> DataFrame:
    return A.profile(t.orders, ["o_totalprice"], 4).select("name", "n", "mean", "p50", "low", "high")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 1.0 END, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, round(o_totalprice * 0.5, 4)) AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'manual' WHEN o_orderkey % 3 = 0 THEN 'direct' ELSE 'formula' END AS origin FROM orders")
def M34_resolve_features(t: Tables) -> DataFrame:
    """The value of the highest precedence among those that there are, and where it comes from."""
    k, v = c("o_orderkey"), c("o_totalprice")
    options = F.array(F.struct(F.lit(1).alias("p"), F.lit("manual").alias("origin"), F.when(k % 4 == 0, 1.0).alias("value")), F.struct(F.lit(2).alias("p"), F.lit("direct").alias("origin"), F.when(k % 3 == 0, v).alias("value")), F.struct(F.lit(5).alias("p"), F.lit("formula").alias("origin"), F.round(v * 0.5, 4).alias("value")))
    long = t.orders.select("o_orderkey", F.inline(options)).where("value is not null")
    return long.groupBy("o_orderkey").agg(F.min_by("value", "p").alias("value"), F.min_by("origin", "p").alias("origin"))


@query(f"WITH {_SC}, d AS (SELECT doc_id, greatest(1, least(10, ceil(round(row_number() OVER (ORDER BY s, doc_id) / count(*) OVER () * 10, 9))))::BIGINT AS decile FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY decile) AS n FROM d) SELECT doc_id, decile, CASE WHEN r <= n * 0.8 THEN 'train' ELSE 'test' END AS split FROM r")
def M35_decile_stratified_split(t: Tables) -> DataFrame:
    ranked = V.percent_rank_first(scored(t), "s", "doc_id", "p").withColumn("decile", V.quantile_bucket(c("p"), 10))
    run = W.partitionBy("decile").orderBy(F.md5(c("doc_id").cast("string")), "doc_id")
    return ranked.withColumns({"r": F.row_number().over(run), "n": F.count("*").over(W.partitionBy("decile"))}).select("doc_id", "decile", F.when(c("r") <= c("n") * 0.8, "train").otherwise("test").alias("split"))


@query(f"WITH {_SC}, h AS (SELECT unnest([0.2, 0.4, 0.6]) AS th), x AS (SELECT th, {_CONF} FROM sc, h GROUP BY 1) SELECT th::DOUBLE AS threshold, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round((tp + fp) / (tp + fp + tn + fn), 6) AS alert_rate FROM x")
def M36_threshold_curve(t: Tables) -> DataFrame:
    rows = scored(t).select("s", "y", F.explode(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.6))).alias("threshold"))
    found = E.confusion(c("s"), c("y"), c("threshold"))
    return rounded(rows.groupBy("threshold").agg(*[found[n].alias(n) for n in ("recall", "precision", "alert_rate")]))


@query("""WITH p AS (SELECT user_id AS k, ts::DATE AS day, count(*) AS n, round(sum(value), 2) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1, 2), f AS (SELECT *, max(errors) OVER w AS worst, coalesce(n - lag(n) OVER (PARTITION BY k ORDER BY day), 0) AS dn, row_number() OVER (PARTITION BY k ORDER BY day DESC) AS r FROM p WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT k, day::VARCHAR AS day, round(1 / (1 + exp(-(-2 + 0.5 * worst + 0.1 * dn))), 8) AS score FROM f WHERE r = 1""")
def M37_score_latest_from_history(t: Tables) -> DataFrame:
    from ledgerline.plans.windows import by_day, panel

    rows = panel(t).withColumns({"worst": F.max("errors").over(by_day().rowsBetween(-2, 0)), "dn": F.coalesce(c("n") - F.lag("n").over(by_day()), F.lit(0))})
    last = J.keep_first(rows, ["k"], [c("day").desc()])
    return last.select("k", c("day").cast("string").alias("day"), F.round(1 / (1 + F.exp(-(-2 + 0.5 * c("worst") + 0.1 * c("dn")))), 8).alias("score"))


STORED = (
    N.Feature("fin_sales", aliases=("sales", "revenue")),
    N.Feature("fin_cost", aliases=("cost",)),
    N.Feature("fin_lines", "integer", ("line_count",)),
    N.Feature("fin_margin_to_tax", needs=("fin_margin", "tax_rate"), formula="try_divide(fin_margin, tax_rate)"),
    N.Feature("fin_margin", needs=("fin_profit", "fin_sales"), formula="try_divide(fin_profit, fin_sales)"),
    N.Feature("fin_profit", needs=("fin_sales", "fin_cost"), formula="fin_sales - fin_cost"),
    N.Feature("fin_loss", "boolean", needs=("fin_profit",), formula="if(fin_profit < 0, 1, 0)"),
)


def order_facts(t: Tables) -> DataFrame:
    """Facts of each order from its lines under names that differ, some of them set by hand or read as the feature itself."""
    k, lines = c("l_orderkey"), t.lineitem
    sums = lines.groupBy(k).agg(F.round(F.sum("l_extendedprice"), 2).alias("sales"), F.round(F.sum(c("l_extendedprice") * c("l_discount")) * 18, 4).alias("cost"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count("*").cast("double").alias("lines"))
    row = lambda layer, name, value, where=None: F.struct(F.lit(layer).alias("layer"), (F.lit(name) if isinstance(name, str) else name).alias("name"), (value if where is None else F.when(where, value)).cast("double").alias("value"))
    every = F.array(
        row("fact", F.when(k % 3 == 0, F.lit("Revenue")).otherwise("sales"), c("sales")), row("fact", "COST", c("cost")), row("fact", "Tax Rate", c("tax")), row("fact", "line-count", c("lines"), k % 2 == 0),
        row("manual_feature", "fin_margin", F.lit(0.5), k % 7 == 0), row("manual", "fin_cost", F.lit(1.0), k % 5 == 0), row("direct", "fin_sales", F.lit(1000.0), k % 11 == 0), row("fact", "fin_profit", F.lit(-1.0), k % 13 == 0),
    )
    return sums.select(k, F.inline(every)).where("value is not null")


_STORE = """WITH s AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS sales, round(sum(l_extendedprice * l_discount) * 18, 4) AS cost, round(avg(l_tax), 6) AS tax, count(*) AS lines FROM lineitem GROUP BY 1),
a AS (SELECT k, tax, CASE WHEN k % 11 = 0 THEN 1000.0 ELSE sales END AS sales, CASE WHEN k % 11 = 0 THEN 'direct' WHEN k % 3 = 0 THEN 'alias revenue' ELSE 'alias sales' END AS s1, CASE WHEN k % 5 = 0 THEN 1.0 ELSE cost END AS cost, CASE WHEN k % 5 = 0 THEN 'manual fact' ELSE 'alias cost' END AS s2, CASE WHEN k % 2 = 0 THEN lines END AS lines FROM s),
b AS (SELECT *, CASE WHEN k % 13 = 0 THEN -1.0 ELSE sales - cost END AS profit, CASE WHEN k % 13 = 0 THEN 'fact' ELSE 'formula' END AS s3 FROM a), d AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0.5 ELSE profit / nullif(sales, 0) END AS margin, CASE WHEN k % 7 = 0 THEN 'manual feature' ELSE 'formula' END AS s4 FROM b),
u AS (SELECT k, 'fin_sales' AS feature, sales::DOUBLE AS value, s1 AS source FROM d UNION ALL SELECT k, 'fin_cost', cost, s2 FROM d UNION ALL SELECT k, 'fin_lines', lines, 'alias line_count' FROM d UNION ALL SELECT k, 'fin_profit', profit, s3 FROM d UNION ALL SELECT k, 'fin_margin', margin, s4 FROM d UNION ALL SELECT k, 'fin_margin_to_tax', margin / nullif(tax, 0), 'formula' FROM d UNION ALL SELECT k, 'fin_loss', (profit < 0)::INTEGER, 'formula' FROM d)"""


@query(f"{_STORE} SELECT k AS l_orderkey, feature, round(value, 8) AS value, source FROM u WHERE value IS NOT NULL")
def M34_feature_store(t: Tables) -> DataFrame:
    """Features by precedence, aliases and formulas over other features, with where each value comes from."""
    return N.resolve(order_facts(t), "l_orderkey", STORED).select("l_orderkey", "feature", F.round("value", 8).alias("value"), "source")


@query(f"{_STORE} SELECT k AS l_orderkey, count(value) AS observed, round(count(value) / 7.0, 4)::DOUBLE AS share, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (value IS NULL), '') AS missing FROM u GROUP BY 1")
def M34_feature_completeness(t: Tables) -> DataFrame:
    """Of each order the features that have a value and the names of those that have none."""
    found = N.completeness(N.resolve(order_facts(t), "l_orderkey", STORED), t.lineitem.select("l_orderkey").distinct(), "l_orderkey", STORED)
    return found.withColumn("missing", F.array_join(F.array_sort("missing"), ","))
