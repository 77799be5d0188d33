"""Resamples, indices of clusters, drift of correlations, and fitted models against plain NumPy on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerline.operators import evaluate as E
from ledgerline.operators import model as M


def plain_auc(y, s):
    p, q = s[y == 1], s[y == 0]
    return ((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q))


def test_resamples_keep_class_totals_and_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(np.clip(0.3 + 0.25 * y + rng.normal(0, 0.25, 400), 0, 1), 2)
    s2 = np.round(rng.random(400), 1)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, s, s2, strict=True)] + [(None, 0.5, 0.5), (1, None, 0.1)], "y int, s double, s2 double")
    got = {r.draw: r for r in E.resampled_auc(df, ["s", "s2"], "y", 1000).collect()}
    assert len(got) == 1000 and got[5] == next(r for r in E.resampled_auc(df, ["s", "s2"], "y", 10).collect() if r.draw == 5)
    pos, neg, auc = np.flatnonzero(y == 1), np.flatnonzero(y == 0), []
    for _ in range(1000):
        some = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        auc.append((plain_auc(y[some], s[some]), plain_auc(y[some], s[some]) - plain_auc(y[some], s2[some])))
    for mine, theirs in (([r.auc_s for r in got.values()], [a for a, _ in auc]), ([r.auc_s - r.auc_s2 for r in got.values()], [d for _, d in auc])):
        assert np.abs(np.quantile(mine, [0.025, 0.5, 0.975]) - np.quantile(theirs, [0.025, 0.5, 0.975])).max() < 0.015
    n, side = np.array([3, 1, 7, 2]), np.array([True, False, True, False])
    times = E.resample_counts(side, n, np.random.default_rng(1))
    assert times[side].sum() == 10 and times[~side].sum() == 3
    order = np.argsort(s, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], s[order][1:] != s[order][:-1])))
    assert abs(E._auc_of(np.ones(400, dtype=int), y[order].astype(bool), edges) - plain_auc(y, s)) < 1e-12
    with pytest.raises(ValueError, match="different rows"):
        E.resampled_auc(df, ["s"], "y", 10, most=5)


def test_cluster_indices(spark):
    rng = np.random.default_rng(4)
    x, k = rng.normal(0, 1, (90, 3)) + np.repeat([[0, 0, 0], [4, 1, 0], [0, 5, 2]], 30, axis=0), np.repeat([0, 1, 2], 30)
    df = spark.createDataFrame([(int(c), [float(v) for v in p]) for c, p in zip(k, x, strict=True)], "cluster int, place array<double>").withColumn("pca", array_to_vector("place"))
    row = M.cluster_indices(df).first()
    centres, all_ = np.array([x[k == c].mean(0) for c in range(3)]), x.mean(0)
    inertia = sum(((x[k == c] - centres[c]) ** 2).sum() for c in range(3))
    between = sum(30 * ((centres[c] - all_) ** 2).sum() for c in range(3))
    spread = [np.linalg.norm(x[k == c] - centres[c], axis=1).mean() for c in range(3)]
    davies = np.mean([max((spread[a] + spread[b]) / np.linalg.norm(centres[a] - centres[b]) for b in range(3) if b != a) for a in range(3)])
    assert np.allclose([row.inertia, row.calinski_harabasz, row.davies_bouldin], [inertia, between / 2 / (inertia / 87), davies]) and row.k == 3 and 0.4 < row.silhouette < 1


def test_matrix_drift(spark):
    a = spark.createDataFrame([("u", "v", 0.5), ("u", "w", -0.2), ("v", "w", 0.1)], "x string, y string, rho double")
    b = spark.createDataFrame([("u", "v", 0.4), ("u", "w", 0.3), ("v", "w", 0.15)], "x string, y string, rho double")
    row = E.matrix_drift(a, b).first()
    assert round(row.mean_shift, 9) == round((0.1 + 0.5 + 0.05) / 3, 9) and (row.flipped, row.pairs) == (1, 3)
    assert abs(row.agreement - np.corrcoef([0.5, -0.2, 0.1], [0.4, 0.3, 0.15])[0, 1]) < 1e-12
    assert [(r.x, r.y) for r in E.matrix_shifts(a, b).orderBy("place").collect()] == [("u", "w"), ("u", "v"), ("v", "w")]


def test_cluster_events(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 0), ("b", 0), ("c", 0)], "k string, y int")
    rows = {r.k: r for r in E.cluster_events(df, "k", "y").collect()}
    assert rows["a"].riskiest and rows["a"].lift == 1.5 and rows["b"].captured == 0.5 and not rows["c"].riskiest


def table(spark, n=200):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (n, 2)) * [3, 10] + [1, -5]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(0, 1, n) > 0).astype(int)
    rows = [(i, None if i % 10 == 0 else float(a), float(b), "kn"[i % 2], int(c), float(0.2 + 0.05 * a - 0.01 * b)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, g string, y int, z double"), rows


def test_preprocessing(spark):
    df, rows = table(spark)
    ready = M.with_indicators(df, ["a", "b"])
    got = np.array([r.features.toArray() for r in M.preprocess(["a", "b"], ["g"]).fit(ready).transform(ready).orderBy("id").collect()])
    a = np.array([np.nan if r[1] is None else r[1] for r in rows])
    known = np.sort(a[~np.isnan(a)])
    filled = np.where(np.isnan(a), known[(len(known) - 1) // 2], a)  # the median is one of the values
    raw = np.stack([filled, [r[2] for r in rows], np.isnan(a), np.zeros(len(a))], axis=1)
    expect = (raw - raw.mean(0)) / np.where(raw.std(0, ddof=1) > 0, raw.std(0, ddof=1), 1)
    assert np.abs(got[:, :4] - expect).max() < 0.02 and got.shape[1] >= 5 and abs(got[:, 4:]).max() > 0.9


def test_classifiers_and_regression(spark):
    df, rows = table(spark)
    y, truth = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    for kind in ("logistic", "boosted", "forest"):
        scored = M.score(M.fit(df, "y", ["a", "b"], ["g"], kind), df, ["a", "b"]).orderBy("id").collect()
        s = np.array([r.score for r in scored])
        assert ((s >= 0) & (s <= 1)).all() and plain_auc(y, s) > 0.9, kind
        assert abs(E.roc_auc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double"), "s", "y").first().auc - plain_auc(y, s)) < 1e-9
    ready = M.with_indicators(df, ["a", "b"])
    found = np.array([r.prediction for r in M.fit_regression(df, "z", ["a", "b"]).transform(ready).orderBy("id").collect()])
    known = np.array([r[1] is not None for r in rows])
    x = np.stack([np.ones(len(rows)), [r[1] or 0.0 for r in rows], [r[2] for r in rows]], axis=1)[known]
    plain = x @ np.linalg.lstsq(x, truth[known], rcond=None)[0]
    assert np.corrcoef(found[known], plain)[0, 1] > 0.999


def test_segments_read_written_rows(spark):
    """What the rows are made of is worked out once, not in each fit and round: no join is left in the plan of the segments."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, *map(float, rng.normal(i % 2 * 5, 1, 2))) for i in range(80)], "id long, a double, b double")
    more = spark.createDataFrame([(i, float(i % 2)) for i in range(80)], "id long, w double")
    rows = M.segments(df.join(more, "id"), ["a", "b", "w"])[1]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert len({(r.id % 2, r.cluster) for r in rows.collect()}) == 2 and rows.count() == 80


def test_resamples_of_many_scores(spark):
    """Beyond the rows that a task may hold; before, this was an error.  Scores in the same, the opposite and no order, each row drawn alike for all."""
    rng = np.random.default_rng(11)
    y = (rng.random(900) < 0.4).astype(int)
    s, t = rng.normal(0, 1, 900) + 0.5 * y, np.where(rng.random(900) < 0.3, 0.25, rng.random(900))
    rows = [(int(a), float(b), float(-b), float(3 * b), 1.0, float(c)) for a, b, c in zip(y, s, t, strict=True)] * 2 + [(1, None, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "y int, s double, down double, up double, flat double, t double")
    found = E.resampled_auc(df, ["s", "down", "up", "flat", "t"], "y", 400, most=100, size=150).collect()
    assert sorted(r.draw for r in found) == list(range(400))
    assert all(abs(r.auc_s + r.auc_down - 1) < 1e-12 and abs(r.auc_s - r.auc_up) < 1e-12 and r.auc_flat == 0.5 for r in found)
    whole = E.resampled_auc(df, ["s", "t"], "y", 400).collect()
    for name in ("auc_s", "auc_t"):
        mine, theirs = (np.array([r[name] for r in x]) for x in (found, whole))
        assert abs(mine.mean() - theirs.mean()) < 5e-3 and 0.8 < mine.std() / theirs.std() < 1.25 and len(set(mine)) > 350
    assert [r.auc_s for r in E.resampled_auc(df.where("y = 1"), ["s"], "y", 5, most=1, size=100).collect()] == [None] * 5
