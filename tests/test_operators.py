"""Operators against brute force on small tables."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import aggregates as A
from ledgerline.operators import evaluate as E
from ledgerline.operators import graph as G
from ledgerline.operators import model as M
from ledgerline.operators import quantiles as Q
from ledgerline.operators import relational as J
from ledgerline.operators import windows as V
from ledgerline.sources import write_table


def test_quantiles_over_many_ranges(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", None)), rng.choice((None, 1.0, 2.0, round(rng.gauss(0, 5), 1))), rng.randrange(50)) for _ in range(700)] + [("only", None, 3)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    points = [0.0, 0.1, 0.5, 0.99, 1.0]
    want = {}
    for g in {r[0] for r in rows}:
        for k, name in ((1, "x"), (2, "y")):
            values = [r[k] for r in rows if r[0] == g and r[k] is not None]
            if values:
                want[g, name] = (len(values), len(set(values)), [float(v) for v in np.quantile(values, points)])
    monkeypatch.setattr(Q, "running_sum", lambda a, b, c, d, _: V.running_sum(a, b, c, d, 40))
    got = {(r.g, r.name): (r.n, r.distinct, list(r.q)) for r in Q.quantiles(df, ["x", "y"], points, ["g"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and np.allclose(got[k][2], want[k][2]) for k in want)
    middle = {r.g: (r.x, r.y) for r in Q.medians(df, ["x", "y"], ["g"]).collect()}
    assert middle["only"] == (None, 3.0) and len(middle) == 4
    assert Q.row_of(df.where("false"), ["x"], points).collect()[0].x is None


def test_bounded_lists(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(25 if k == 1 else 3)] * 2, "g int, m int")
    got = {(r.g, r.part): r.members for r in A.member_lists(df, "g", "m", 10).collect()}
    assert got == {(1, 0): ",".join(map(str, range(10))), (1, 1): ",".join(map(str, range(10, 20))), (1, 2): "20,21,22,23,24", (2, 0): "0,1,2"}


def history(seed: int) -> tuple[list, list, list]:
    rng, day = random.Random(seed), lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    apps = [(i, rng.randrange(6), 0, dt.date(2020, rng.randint(2, 11), 1) - dt.timedelta(days=1)) for i in range(40)]
    apps = [(i, n, n % 2, s) for i, n, _, s in apps]
    ties = list({(rng.randrange(6), rng.randrange(6, 12)): None for _ in range(20)})
    ties = [(a, b, day(rng.randrange(365)), day(rng.randrange(365)) if b % 2 else None) for a, b in ties]
    paid = [(rng.randrange(6), rng.randrange(20, 24), day(rng.randrange(365)), float(rng.randint(1, 50))) for _ in range(150)]
    return apps, ties, paid


SCHEMAS = ("id int, node int, grp int, snap date", "node int, other int, since date, event_at date", "node int, other int, at date, amount double")


def known(apps, ties, paid):
    out = {}
    for i, node, grp, snap in apps:
        mine = [(o, e) for n, o, since, e in ties if n == node and since <= snap]
        amounts: dict = defaultdict(float)
        for n, o, at, amount in paid:
            if n == node and at <= snap:
                amounts[o] += amount
        whole = sum(a for n, _, at, a in paid if n in {x[1] for x in apps if x[2] == grp} and at <= snap)
        total = sum(amounts.values())
        rate = sum(e is not None and e <= snap for _, e in mine) / len(mine) if mine else None
        out[i] = (len(mine), rate, len(amounts), sum(a * a for a in amounts.values()) / total**2 if total else None, total / whole if total else None)
    return out


def test_point_in_time_features_and_no_leak(spark):
    apps, ties, paid = history(2)
    tables = lambda *rows: [spark.createDataFrame(r, s) for r, s in zip(rows, SCHEMAS, strict=True)]

    def found(*rows):
        return {r.id: (r.degree, r.rate, r.partners, r.hhi, r.group_share) for r in G.point_in_time(*tables(*rows), "id").collect()}

    got, want = found(apps, ties, paid), known(apps, ties, paid)
    assert got.keys() == want.keys()
    for i in want:
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got[i], want[i], strict=True)), i
    last = max(s for *_, s in apps)
    late = [(a, b, s, e) for a, b, s, e in ties] + [(n, 99, last + dt.timedelta(days=1), None) for n in range(6)]
    later = paid + [(n, 98, last + dt.timedelta(days=2), 1000.0) for n in range(6)]
    assert found(apps, late, later) == got  # what begins after the snapshots changes nothing
    shuffled = [random.Random(3).sample(x, len(x)) for x in (apps, ties, paid)]
    assert {k: tuple(None if v is None else round(v, 9) for v in x) for k, x in found(*shuffled).items()} == {k: tuple(None if v is None else round(v, 9) for v in x) for k, x in got.items()}


def test_depth_of_falling_and_cyclic_chains(spark):
    edges = spark.createDataFrame([(9, 7), (7, 5), (5, 3), (1, 2), (2, 1), (2, 4), (20, 21), (21, 22), (22, 20)], "src long, dst long")
    members = spark.createDataFrame([(n, 1 if n < 10 else 2) for n in (1, 2, 3, 4, 5, 7, 9, 20, 21, 22)] + [(30, 3)], "node long, grp int")
    assert {r.grp: r.depth for r in G.depth(edges, members).collect()} == {1: 3, 2: 2, 3: 1}
    with pytest.raises(RuntimeError):
        G.depth(edges, members, 2)


def test_cycles_leave_out_hubs(spark):
    rows = [(0, i) for i in range(1, 30)] + [(i, 0) for i in range(1, 30)] + [(40, 41), (41, 40)]
    df = spark.createDataFrame(rows, "src long, dst long")
    assert {r.node for r in G.cycles(df, 4, 20).collect()} == {40, 41} and len(G.cycles(df, 4).collect()) == 32


def test_unsettled_work_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        G.components(chain, "a", "b", 1)
    nodes = spark.createDataFrame([(i,) for i in range(301)], "node long")
    with pytest.raises(RuntimeError):
        G.betweenness(chain.withColumn("w", F.lit(1.0)), nodes, 2, 3)


def test_ego_takes_turns_within_its_budget(spark):
    edges = spark.createDataFrame([(0, 10 + i, "a") for i in range(6)] + [(0, 20 + i, "b") for i in range(6)] + [(10, 30 + i, "a") for i in range(9)], "src long, dst long, rel string")
    rows = [(r.node, r.hop) for r in G.ego(edges, spark.createDataFrame([(0,)], "start long"), 2, 8).collect()]
    # ceil(7 * 0.6) = 5 at the first hop, relations in turn; what is left at the second
    assert sorted(n for n, h in rows if h == 1) == [10, 11, 12, 20, 21] and sorted(n for n, h in rows if h == 2) == [30, 31] and len(rows) == 8


def test_hubs_are_chosen_by_size(spark):
    rows = [(f"h{k}", k * 100 + i) for k, n in enumerate((1, 2, 5, 40)) for i in range(n)] + [("h1", 200)]
    got = {(r.member, r.hub) for r in G.hub_selection(spark.createDataFrame(rows, "hub string, member int"), "hub", "member", 2, 30, 100).collect()}
    assert {m for m, _ in got} == {100, 101, 200, 201, 202, 203, 204} and len(got) == 7


def test_resamples_are_the_same_again_and_centred(spark):
    rng = random.Random(5)
    rows = [(i, y, round(rng.gauss(y, 1.5), 2), round(rng.gauss(y, 1.5), 2)) for i in range(400) for y in (rng.randint(0, 1),)]
    df = spark.createDataFrame(rows, "id int, y int, s double, s2 double")
    draws = E.bootstrap_auc(df, ["s", "s2"], "y", "id", 300).orderBy("draw").collect()
    assert draws == E.bootstrap_auc(df.orderBy(F.rand(1)), ["s", "s2"], "y", "id", 300).orderBy("draw").collect()
    for name in ("s", "s2"):
        full = E.roc_auc(df, name, "y").first().auc
        found = np.array([r[f"auc_{name}"] for r in draws])
        assert abs(found.mean() - full) < 0.01 and 0.01 < found.std() < 0.06


def test_folds_fit_and_calibration(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 60, float(y + rng.gauss(0, 1)), rng.choice((None, 1.0, 2.0)), y) for i in range(600) for y in (int(rng.random() < 0.3),)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, y int")
    write_table(df, str(tmp_path), "gold", "rows")  # a write before must not keep models from being sent to tasks
    folds = G.cut(E.group_folds(df, "g", "y", 3))
    sizes = Counter(r.fold for r in folds.collect())
    assert set(sizes.values()) == {20} and folds.select("g").distinct().count() == 60
    scored = G.cut(M.out_of_fold(df, folds, "g", "y", ["a", "b"], 3))
    assert scored.count() == 600 and scored.select("id").distinct().count() == 600
    assert E.roc_auc(scored, "score", "y").first().auc > 0.7
    fixed = M.platt(scored.select("id", "y", "score"), "score", "y").orderBy("score").collect()
    assert all(x.calibrated <= y.calibrated + 1e-12 for x, y in zip(fixed, fixed[1:], strict=False)) and abs(np.mean([r.calibrated for r in fixed]) - np.mean([r.y for r in fixed])) < 0.02


def test_token_join_finds_every_pair_among_copies(spark):
    """Against all pairs: copies, words in another order, a match that must share 7 of 25 words (25 * 0.28 is above 7 in doubles), sets too long to match."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefghij"), rng.integers(1, 7))) for _ in range(60)] + ["a b c", "c b a", "a b c"] + [""]
    texts += [" ".join(f"w{i}" for i in range(25)), " ".join(f"w{i}" for i in range(7)), " ".join(f"w{i}" for i in range(40))]
    rows = spark.createDataFrame([(i, x.split()) for i, x in enumerate(texts)], "id long, t array<string>")
    for threshold in (0.28, 0.5, 0.8):
        got = {(r.q, r.id): r.score for r in J.token_jaccard_join(rows.where("id % 3 = 1").withColumnRenamed("id", "q"), rows, "q", "id", "t", threshold).collect()}
        sets = [set(x.split()) for x in texts]
        want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) if i % 3 == 1 for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= threshold}
        assert got == want


def test_token_join_shuffles_no_row(spark):
    """Words that all texts share, small shares of queries and small blocks: the pairs of brute force, and nothing but the queries is written or dealt out."""
    rng = np.random.default_rng(4)
    texts = [["the", "of", *rng.choice(list("abcdefgh"), rng.integers(0, 6)).tolist()] for _ in range(80)] + [[], None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, t array<string>")
    found = J.token_jaccard_join(rows.where("id % 4 = 1").withColumnRenamed("id", "q"), rows, "q", "id", "t", 0.3, share=20, block=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    sets = [set(x or ()) for x in texts]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) if i % 4 == 1 for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= 0.3}
    rows_ = found.collect()
    assert {(r.q, r.id): r.score for r in rows_} == want and len(rows_) == len(want) > 100
