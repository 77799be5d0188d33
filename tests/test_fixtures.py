"""The small hand-made fixtures: calculators, a mini index, facts of a page, and inputs in another order."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import credit as K
from ledgerline.operators import relational as J
from ledgerline.operators import search as S
from ledgerline.operators import windows as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_calculators(spark):
    lit = F.lit
    # an annuity pays the principal back with interest; without interest it is the principal's share; a revolving limit pays interest only
    pay, plain, revolving, never = one(spark, K.instalment(lit(120.0), lit(12), lit(0.12)), K.instalment(lit(120.0), lit(12), lit(0.0)), K.instalment(lit(120.0), lit(12), lit(0.12), lit(True)), K.instalment(lit(120.0), lit(0), lit(0.12)))
    left = 120.0
    for _ in range(12):
        left = left * 1.01 - pay
    assert abs(left) < 1e-9 and plain == 10.0 and math.isclose(revolving, 1.2) and never is None
    # collateral beyond the limit recovers no more than the limit, a negative value nothing
    kind = next(iter(K.RECOVERY))
    full, over, none = one(spark, *[K.lgd_collateral(lit(kind), lit(v), lit(100.0)) for v in (100.0, 500.0, -5.0)])
    assert full == over == 1 - K.RECOVERY[kind] and none == 1.0
    # grades are closed to the right, and there is none outside of 0 to 1
    bounds = list(K.GRADES.items())
    assert one(spark, *[K.grade_from_pd(lit(float(b))) for _, b in bounds]) == tuple(g for g, _ in bounds)
    assert one(spark, K.grade_from_pd(lit(0.0)), K.grade_from_pd(lit(-0.1)), K.grade_from_pd(lit(1.1))) == (bounds[0][0], None, None)
    assert one(spark, K.dscr(lit(10.0), lit(0.0), lit(0.0)), K.dscr(lit(10.0), lit(4.0), lit(1.0))) == (None, 2.0)
    # weak grades go to the last committee whatever the limit
    assert one(spark, K.authority(lit(1.0), lit("CCC")), K.authority(lit(float(K.AUTHORITY[0][0])), lit("A")))[0] == K.AUTHORITY[-1][1]


def test_mini_index(spark):
    # three chunks with cosines .62, .55, .55; section 12 is cited and stands in two chunks
    rows = [(0, 1, 0.62, 0.0, False), (0, 2, 0.55, 0.0, True), (0, 3, 0.55, 1.0, True)]
    scores = spark.createDataFrame(rows, "q int, c int, cosine double, lexical double, cited boolean")
    order = lambda **k: [r.c for r in S.hybrid(scores, "q", "c", 1, 0.35, "c", **k).orderBy("place").collect()]
    assert order() == [3] and order(cited="cited") == [2, 3]  # all that is cited, in order of the document, beyond k
    assert [r.c for r in S.hybrid(scores, "q", "c", 3, 0.0, "c").orderBy("place").collect()] == [1, 2, 3]  # ties by name
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(S.normalised("v").alias("v")).collect()
    assert [list(r.v) for r in vectors] == [[0.6, 0.8], [0.0, 0.0]]
    words = lambda rows: spark.createDataFrame(rows, "id int, t array<string>")
    found = {r.c: r.lexical for r in S.lexical(words([(9, ["loan", "rate"])]).withColumnRenamed("id", "q"), words([(1, ["loan", "rate"]), (2, ["loan"] * 9), (3, ["other"])]).withColumnRenamed("id", "c"), "q", "c", "t").collect()}
    assert found[1] == 1.0 and 0 < found[2] < 1 and 3 not in found


def test_page_facts(spark):
    page = "CONSOLIDATED BALANCE SHEET\nIn millions of rupiah\nCurrent assets   1.250,50\nNet income (12,345)\nTotal liabilities\n(9.876)\nTax rate 22%\nNote 7\nno number here"
    df = spark.createDataFrame([(page,)], "p string").select(F.explode(X.join_label_value(F.split("p", "\n"))).alias("line"))
    read = lambda label: [r[0] for r in df.select(X.value_after("line", label).alias("v")).where("v is not null").collect()]
    assert read(r"current\s+assets") == [1250.5] and read(r"net\s+income") == [-12345.0] and read(r"total\s+liabilities") == [-9876.0] and read(r"tax\s+rate") == [0.22] and read("equity") == []
    assert df.count() == 8  # the label and its number have become one line


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(8)
    stamp = lambda n: f"{2000 + n // 300}-{1 + n // 30 % 10:02d}-{1 + n % 28:02d}"
    left = [(i, rng.randrange(4), stamp(rng.randrange(1500))) for i in range(200)]
    right = [(i, rng.randrange(3), stamp(rng.randrange(1500)), i * 10) for i in range(40)]
    a = spark.createDataFrame(left, "id int, k int, at string").withColumn("at", F.to_date("at"))
    b = spark.createDataFrame(right, "o int, k int, since string, v int").withColumn("since", F.to_date("since"))
    want = {}
    for i, k, at in left:
        seen = [(s, o, v) for o, rk, s, v in right if rk == k and s <= at]
        want[i] = max(seen)[2] if seen else None
    for span in ("month", "year", "century"):
        assert {r.id: r.asof_v for r in J.asof_join(a, b, "k", "at", "since", ["v"], "o", span).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_input_does_not_matter(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice((1.0, 1.0, 2.0, None, 5.0))) for i in range(60)]
    schema = "id int, x double"
    mixed = rng.sample(rows, len(rows))
    for run in (lambda d: V.percent_rank_first(d, "x", "id", "p"), lambda d: V.percentile_rank(d, "x", "p")):
        one_, other = (sorted(map(tuple, run(spark.createDataFrame(r, schema)).collect()), key=repr) for r in (rows, mixed))
        assert one_ == other
