"""Documents and features by hand: rules with evidence, holders, forms, collateral, chunks, budgets, formulas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import documents as O
from ledgerline.operators import features as N
from ledgerline.operators import search as S

PAGES = [
    (1, 1, "CONSOLIDATED BALANCE SHEET\nIn millions of rupiah\nCurrent assets   1.250,50\nTotal current assets: 2.000\nEquity\n(9.876)\nNote 7\n"),
    (1, 2, "Total current assets 3 billion\nTax rate 22%\nTenor: 35.6\nEquity Rp 10"),
    (2, 1, None), (3, 1, ""),
]
RULES = (O.Rule("current_assets", (r"current\s+assets", r"^total\s+current\s+assets$"), "money", 100), O.Rule("equity", ("^equity$",)), O.Rule("tax", (r"tax\s+rate",), "percent"), O.Rule("tenor", ("^tenor",), "int"))


def test_facts_with_evidence(spark):
    found = O.facts(spark.createDataFrame(PAGES, "doc int, page int, text string"), RULES)
    rows = {(r.item, r.page, r.line): (r.value, r.unit, r.score, r.quote) for r in found.collect()}
    assert rows["current_assets", 1, 2] == (1250.5e6, 1e6, 100, "Current assets 1.250,50")  # the page's unit; the label's first line
    assert rows["current_assets", 1, 3] == (2000e6, 1e6, 117, "Total current assets: 2.000")  # the other expression; total and colon
    assert rows["current_assets", 2, 0] == (3e9, 1e9, 115, "Total current assets 3 billion")  # the line's unit
    assert rows["equity", 1, 4][:2] == (-9876e6, 1e6) and rows["equity", 2, 3][:2] == (10.0, 1.0)  # label and number on two lines
    assert rows["tax", 2, 1][0] == 0.22 and rows["tenor", 2, 2][0] == 36.0 and {k[1] for k in rows} == {1, 2}
    best = {r.item: (r.value, r.page) for r in O.best_facts(found).collect()}
    assert best == {"current_assets": (2000e6, 1), "equity": (-9876e6, 1), "tax": (0.22, 2), "tenor": (36.0, 2)}


def test_facts_are_found_in_one_pass_and_one_shuffle(spark, capsys):
    pages = spark.createDataFrame(PAGES, "doc int, page int, text string")
    O.best_facts(O.facts(pages, RULES)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "regexp_extract" not in plan
    assert plan.index("Generate posexplode") < plan.index("trillions?")  # a page's unit comes below its lines
    # Line separators of other alphabets, a label of marks, a number alone: as before.
    odd = spark.createDataFrame([(1, 1, "Equity 5\u2028\nAssets\n7 trillion\n12\nEquity: $1 9"), (1, 2, "Equity \\1 (3)")], "doc int, page int, text string")
    found = {(r.page, r.line): (r.item, r.value, r.quote) for r in O.facts(odd, (O.Rule("equity", ("^equity",)),)).collect()}
    assert found == {(1, 0): ("equity", 5.0, "Equity 5\u2028"), (2, 0): ("equity", -3.0, "Equity \\1 (3)")}


def test_holders(spark):
    stacked = "LIST OF HOLDERS\n 1\nAda Lovelace\n 25.000.000\nPresident  director\n2\nBob & Sons\n15.000.000\nShareholder\nAda LOVELACE\n1.000\nManager\nTOTAL\n50.000.000"
    inline = "Deed\n1. Carol Jones: 60,5%\nDan - 39.5 %\ncarol jones 10%\nToo much 250%"
    many = "\n".join(f"Holder {i}\n{i},000\nDirector" for i in range(1, 16))
    docs = spark.createDataFrame([(1, stacked), (2, inline), (3, many), (4, None), (5, "nothing here")], "doc int, text string")
    rows = O.holders(docs).collect()
    of = lambda d: [(r.name, round(r.share, 4), r.position) for r in sorted(rows, key=lambda r: r.place) if r.doc == d]
    assert of(1) == [("Ada Lovelace", 0.5, "President director"), ("Bob & Sons", 0.3, "Shareholder")]
    assert of(2) == [("Carol Jones", 0.605, None), ("Dan", 0.395, None)]
    assert len(of(3)) == 12 and of(3)[0] == ("Holder 15", round(15 / 120, 4), "Director") and not of(4) and not of(5)


def test_forms_and_collateral(spark):
    form = "Borrower name: Acme\nRM\nJane Doe\nLimit   Rp 45,000\nPurpose:\nTerm:\nClass / Grade\nCorporate / BBB\nRevolving: Yes\nCross guarantee: none"
    names = {"name": ("borrower name", "name"), "manager": ("relationship manager", "rm"), "limit": ("limit",), "purpose": ("purpose",), "grade": ("grade",), "revolving": ("revolving",), "cross": ("cross guarantee",), "absent": ("absent",)}
    r = O.fields(spark.createDataFrame([(1, form)], "doc int, text string"), names, ["revolving", "cross"]).first()
    assert (r["name"], r.manager, r.limit, r.purpose, r.grade, r.revolving, r.cross, r.absent) == ("Acme", "Jane Doe", "Rp 45,000", None, "BBB", True, False, None)
    goods = "C. COLLATERAL\n1. Land and building appraised Rp 9,000 million liquidation Rp 7,000 million\n2. Truck\nAppraised: 300\nLiquidation: 200\n3. Nothing more"
    rows = O.collateral(spark.createDataFrame([(1, goods), (2, None)], "doc int, text string")).collect()
    assert [(x.place, x.kind, x.appraised, x.liquidation) for x in rows] == [(1, "Land and building", 9e9, 7e9), (2, "Truck", 300.0, 200.0)]


def test_chunks(spark):
    long = "\n".join(f"line {i} of a long article that goes on and on" for i in range(60))
    first = "PREAMBLE of some length that is long enough to stay here\nCHAPTER I\nArticle 1\nshort text of the first article, just long enough\nArticle 2\n"
    docs = spark.createDataFrame([(1, 1, first), (1, 2, long), (2, 1, None)], "doc int, page int, text string")
    rows = sorted(O.chunks(docs, r"^\s*Article ([0-9]+)\s*$", r"^\s*CHAPTER ([IVX]+)\s*$", 400, 50).collect(), key=lambda r: r.place)
    whole = first + "\n" + long
    assert [(r.chapter, r.section) for r in rows[:2]] == [(None, None), ("I", "1")] and {(r.chapter, r.section) for r in rows[2:]} == {("I", "2")}
    assert (rows[1].first_page, rows[1].last_page, rows[-1].first_page) == (1, 1, 2) and rows[2].last_page == 2 and rows[1].label == "doc 1 · section 1 · p. 1"
    for r, after in zip(rows[2:], [*rows[3:], None], strict=True):
        assert whole[r.at :].lstrip().startswith(r.chunk[:30]) and len(r.chunk) <= 400
        end = whole.index(r.chunk, r.at) + len(r.chunk)
        assert after is None or whole[end] == "\n" and after.at >= r.at + 350  # no chunk ends within a line
    assert whole.endswith(rows[-1].chunk)


def test_reduction_never_over_budget(spark):
    long = "\n".join(["head"] * 8 + ["dull"] * 20 + ["near", "the LOAN here", "near"] + ["dull"] * 20)
    docs = spark.createDataFrame([(1, 1, "a short page\nof two lines"), (1, 2, long), (1, 3, None)] + [(2, p, long * 3) for p in range(9)], "doc int, page int, text string")
    rows = {r.doc: r for r in O.reduced(docs, ["loan"], budget=500, short=100).collect()}
    assert rows[1].reduced == "[page 1]\na short page\nof two lines\n\n[page 2]\n" + "\n".join(["head"] * 6 + ["near", "the LOAN here", "near"]) and rows[1].chosen == 11
    text = rows[2].reduced
    assert len(text) <= 500 and text.startswith("[page 0]\nhead") and text.endswith("near") and "[... reduced ...]" in text and 340 < text.index("[...") < 350


FEATURES = (N.Feature("c", needs=("b", "tax"), formula="try_divide(b, tax)"), N.Feature("b", needs=("a",), formula="a * 2"), N.Feature("a", aliases=("first_name", "other")), N.Feature("n", "integer"), N.Feature("flag", "boolean", ("is_new",)))


def test_features_resolve_in_order(spark):
    facts = [
        (1, "fact", "Other", 5.0), (1, "fact", "First-Name", 7.0), (1, "fact", "tax", 2.0), (1, "fact", "n", 3.9), (1, "manual", "is new", 1.0),
        (2, "direct", "a", 1.0), (2, "fact", "a", 9.0), (2, "manual_feature", "b", 50.0), (2, "fact", "tax", 0.0),
        (3, "manual", "a", 4.0), (3, "direct", "a", 1.0), (3, "manual", "tax", 8.0), (3, "fact", "tax", 1.0),
    ]
    found = N.resolve(spark.createDataFrame(facts, "k int, layer string, name string, value double"), "k", FEATURES)
    rows = {(r.k, r.feature): (r.value, r.source, r.formula) for r in found.collect()}
    assert rows == {
        (1, "a"): (7.0, "alias first_name", None), (1, "b"): (14.0, "formula", "a * 2"), (1, "c"): (7.0, "formula", "try_divide(b, tax)"), (1, "n"): (3.0, "fact", None), (1, "flag"): (1.0, "alias is_new, manual", None),
        (2, "a"): (1.0, "direct", None), (2, "b"): (50.0, "manual feature", None), (3, "a"): (4.0, "manual fact", None), (3, "b"): (8.0, "formula", "a * 2"), (3, "c"): (1.0, "formula", "try_divide(b, tax)"),
    }
    keys = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    whole = {r.k: (r.observed, r.share, sorted(r.missing)) for r in N.completeness(found, keys, "k", FEATURES).collect()}
    assert whole == {1: (5, 1.0, []), 2: (2, 0.4, ["c", "flag", "n"]), 9: (0, 0.0, ["a", "b", "c", "flag", "n"])}


def test_formulas_in_a_circle_are_an_error():
    with pytest.raises(ValueError, match="need each other"):
        N.ordered((N.Feature("x", needs=("y",), formula="y"), N.Feature("y", needs=("x",), formula="x")))
    assert [f.name for f in N.ordered(FEATURES) if f.name in "abc"] == ["a", "b", "c"]


def test_likeness_keeps_what_ranks_and_meets_all_pairs(spark):
    """Rows in several shares and blocks; before, all pairs went through a shuffle to be ranked."""
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    bags = [{f"t{j}": float(j + 1) for j in rng.choice(20, 5, replace=False)} for _ in range(60)]
    rows = [(i, None if i == 7 else v[i].tolist(), list(bags[i]), list(bags[i].values())) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, terms array<string>, w array<double>")
    asked = df.where("id % 10 = 0").withColumn("w", F.transform("w", lambda x: x / 500.0))
    got = {(r.q, r.c): (r.cosine, r.lexical) for r in S.likeness(df, asked, "q", "c", most=16, share=3, block=2).collect()}
    assert len(got) == 360
    for (q, c), (cosine, lexical) in got.items():
        assert (cosine is None) == (c == 7) and (cosine is None or abs(cosine - v[q] @ v[c]) < 1e-12)
        assert abs(lexical - min(1.0, sum(x * bags[q][t] / 500 for t, x in bags[c].items() if t in bags[q]))) < 1e-12
    some = {(r.q, r.c) for r in S.likeness(df, asked, "q", "c", (2, 0.35, lambda r, q: (r + q) % 9 == 5), most=16, share=3, block=2).collect()}
    for q in range(0, 60, 10):
        score = sorted(((-(0.65 * (got[q, c][0] or 0.0) + 0.35 * got[q, c][1]), c) for c in range(60) if (c + q) % 9 != 5))[:2]
        assert {(q, c) for _, c in score} | {(q, c) for c in range(60) if (c + q) % 9 == 5} <= some
    assert len(some) < 360


def test_lines_of_holders_are_read_once(spark):
    """The expressions of numbers of shares and of shares in per cent stand once, and twice (its two groups), in the plan of what is read."""
    docs = spark.createDataFrame([(1, "Total\n9.000\ntotally Ltd\n1.000\nOwner\nAda\t\x0b Byron\r\n3.000\nmanager"), (2, None)], "doc int, text string")
    found = O.holders(docs)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count(O._COUNT) == 1 and plan.count(O._PERCENT) == 2
    assert [(r.doc, r.place, r.name, round(r.share, 6), r.position) for r in found.collect()] == [(1, 1, "Ada Byron", round(3000 / 9000, 6), "manager")]


def test_lines_are_joined_only_where_a_number_stands_alone(spark):
    rows = spark.createDataFrame([(["a", "b 1"],), (["a", "(12)", "b", "Rp 3", "4"],), (None,), (["a", None, "5"],)], "l array<string>")
    assert [r.j for r in rows.select(X.join_label_value("l").alias("j")).collect()] == [["a", "b 1"], ["a (12)", "b Rp 3", "4"], None, ["a", None, "5"]]
    assert "CASE WHEN exists" in rows.select(X.join_label_value("l"))._jdf.queryExecution().analyzed().toString()
