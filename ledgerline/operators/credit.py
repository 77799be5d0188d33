"""Credit tables and policy arithmetic as column expressions over a table of applications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Col, clip, col, lookup, names_where, null_if_zero

# Fixed values of the credit policy.
GRADES = {"AAA": 0.008, "AA": 0.016, "A": 0.030, "BBB": 0.055, "BB": 0.095, "B": 0.185, "CCC": 1.000}
COVENANTS = {
    "AAA": (2.50, 2.00, 1.25),
    "AA": (2.50, 2.00, 1.25),
    "A": (2.25, 2.25, 1.25),
    "BBB": (2.25, 2.25, 1.25),
    "BB": (2.00, 2.50, 1.35),
    "B": (1.75, 3.00, 1.50),
    "CCC": (1.50, 3.50, 1.75),
}
COVERAGE_MIN = {"AAA": 1.00, "AA": 1.00, "A": 1.10, "BBB": 1.25, "BB": 1.25, "B": 1.50, "CCC": 1.50}
RECOVERY = {"none": 0.10, "receivables": 0.35, "inventory": 0.40, "machinery": 0.48, "guarantee": 0.45, "land": 0.78, "cash": 0.95}
SEGMENT = {"sales": (30e9, 300e9), "limit": (10e9, 150e9), "balance": (10e9, 50e9)}
AUTHORITY = ((25e9, "regional"), (75e9, "commercial"), (150e9, "central"))
FUNDING, OPERATING, MARGIN, PRICE_MIN, PRICE_MAX = 0.0475, 0.0060, 0.0225, 0.07, 0.16
GROUP_LIMIT, DSCR_MIN = 750e9, 1.25
BAND_CUTS, BANDS = (0.0762, 0.2921, 0.7060), ("low", "medium", "high", "very high")
BAND_CAPS = {"low": 90e9, "medium": 90e9, "high": 80e9, "very high": 70e9}
COVENANT_TABLE = {"der_max": {"AAA": 1.5, "AA": 1.75, "A": 2.0, "BBB": 2.5, "BB": 3.0, "B": 3.5}, "icr_min": {"AAA": 4.0, "AA": 3.5, "A": 3.0, "BBB": 2.5, "BB": 2.0, "B": 1.5}}


def split_at(at: Col, cut: str) -> Column:
    """train up to and with the cut, out of time after it."""
    return F.when(col(at) <= F.lit(cut).cast("date"), "train").when(col(at).isNotNull(), "oot")


def horizon_target(start: Col, event: Col, months: int, observed_until: str) -> dict[str, Column]:
    """The three-valued target: 1 for an event within the horizon, 0 for a whole horizon without one, else null."""
    end, last = F.add_months(col(start), months), F.lit(observed_until).cast("date")
    hit = F.coalesce(col(event) <= end, F.lit(False))
    censored = (end > last) & ~hit
    return {"y": F.when(~censored, hit.cast("int")), "y_censored": censored, "y_age": F.datediff(col(event), col(start)), "y_observed": F.datediff(F.coalesce(col(event), last), col(start))}


def lgd_realised(charged: Col, disbursed: Col, defaulted: Column) -> Column:
    return F.when(defaulted, clip(col(charged) / null_if_zero(disbursed), 0.0, 1.0))


def ratios(sales: Col, ebitda: Col, debt: Col, equity: Col, interest: Col, net_income: Col, assets: Col, liabilities: Col) -> dict[str, Column]:
    """Ratios with undefined ones null, and a note where the cover of interest is undefined."""
    icr = F.when(col(interest) > 0, col(ebitda) / col(interest))
    return {
        "der_interest": col(debt) / null_if_zero(equity),
        "der_total": col(liabilities) / null_if_zero(equity),
        "debt_to_ebitda": F.when(col(ebitda) > 0, col(debt) / col(ebitda)),
        "icr": icr,
        "ebitda_margin": col(ebitda) / null_if_zero(sales),
        "net_margin": col(net_income) / null_if_zero(sales),
        "roe": col(net_income) / null_if_zero(equity),
        "roa": col(net_income) / null_if_zero(assets),
        "note": F.when(icr.isNull(), "interest cover undefined"),
    }


def instalment(principal: Col, months: Col, rate: Col, revolving: Column | None = None) -> Column:
    """A month's payment: an annuity, the principal's share at no interest, or interest alone for revolving limits."""
    i = col(rate) / 12
    annuity = F.when(i == 0, col(principal) / null_if_zero(months)).otherwise(col(principal) * i / (1 - F.pow(1 + i, -col(months))))
    annuity = F.when(col(months) > 0, annuity)
    return annuity if revolving is None else F.when(revolving, col(principal) * i).otherwise(annuity)


def dscr(ebitda: Col, new_service: Col, old_service: Col) -> Column:
    return col(ebitda) / null_if_zero(col(new_service) + col(old_service))


def lgd_collateral(kind: Col, value: Col, limit: Col) -> Column:
    return 1 - lookup(kind, RECOVERY) * F.least(F.greatest(col(value), F.lit(0.0)) / null_if_zero(limit), F.lit(1.0))


def grade_from_pd(pd: Col) -> Column:
    """The first grade whose bound is at least the probability; null outside 0 to 1."""
    out: Column | None = None
    for grade, bound in GRADES.items():
        hit = (col(pd) >= 0) & (col(pd) <= bound)
        out = F.when(hit, grade) if out is None else out.when(hit, grade)
    return out


def pricing(pd: Col, lgd: Col) -> dict[str, Column]:
    raw = FUNDING + OPERATING + col(pd) * col(lgd) + MARGIN
    return {"raw": raw, "pricing": clip(raw, PRICE_MIN, PRICE_MAX), "at_bound": (raw < PRICE_MIN) | (raw > PRICE_MAX)}


def segment_fails(**values: Col) -> Column:
    """Names of the dimensions outside of the segment's bounds."""
    return names_where(**{n: ~col(v).between(*SEGMENT[n]) for n, v in values.items()})


def covenant_fails(grade: Col, der_total: Col, der_interest: Col, dscr_: Col, icr: Col) -> dict[str, Column]:
    """Violated covenants by grade.  The total basis counts; the interest-bearing one stands in.  No cover fails."""
    bound = lambda i: lookup(grade, {g: v[i] for g, v in COVENANTS.items()})
    fails = names_where(der=F.coalesce(col(der_total), col(der_interest)) > bound(0), dscr=col(dscr_) < bound(2), icr=F.coalesce(col(icr) < bound(1), F.lit(True)))
    return {"basis": F.when(col(der_total).isNotNull(), "total").otherwise("interest"), "violated": fails, "passed": F.size(fails) == 0}


def authority(limit: Col, grade: Col) -> Column:
    """The committee by limit, the last one for weak grades."""
    last = AUTHORITY[-1][1]
    out = F.when(col(grade).isin("B", "CCC"), last)
    for bound, name in AUTHORITY:
        out = out.when(col(limit) <= bound, name)
    return out.otherwise(last)


def guard(**bad: Column) -> Column:
    """The names of failed input checks, joined; null if there are none."""
    found = names_where(**{n: F.coalesce(b, F.lit(True)) for n, b in bad.items()})
    return F.when(F.size(found) > 0, F.array_join(found, ","))


def band(score: Col, cuts: Sequence[float] = BAND_CUTS, names: Sequence[str] = BANDS) -> Column:
    """Right-closed bands of a score."""
    out = F.when(col(score) <= cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:], strict=False):
        out = out.when(col(score) <= cut, name)
    return out.when(col(score).isNotNull(), names[len(cuts)])


def limit_recommendation(request: Col, ebitda: Col, months: Col, rate: Col, revolving: Column, band_: Col, exposure: Col, collateral: Col, coverage: float = 1.25, cash: float = 0.75) -> dict[str, Column]:
    """The least of what is asked for and of four caps, rounded down to billions, and the cap that binds."""
    pay = col(ebitda) * cash / (DSCR_MIN * 12)
    i = col(rate) / 12
    capacity = F.when(revolving, pay / i).otherwise(pay * (1 - F.pow(1 + i, -col(months))) / i)
    caps = {
        "cash flow": capacity,
        "band": lookup(band_, BAND_CAPS),
        "group": F.greatest(GROUP_LIMIT - col(exposure), F.lit(0.0)),
        "collateral": F.when(col(collateral) > 0, col(collateral) / coverage).otherwise(F.least(col(request), F.lit(SEGMENT["limit"][0]))),
    }
    least = F.least(col(request), *caps.values())
    limit = F.greatest(F.floor(least / 1e9) * 1e9, F.lit(0.0))
    listed = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(k + 1).alias("i"), F.lit(n).alias("n")) for k, (n, v) in enumerate(caps.items())]))
    return {"limit": limit.cast("double"), "bound_by": F.when(limit < col(request), listed[0]["n"])}


def policy_gate(**aspects: Column) -> dict[str, Column]:
    """Aspects by status (pass, adjust or review) and the overall status."""
    statuses = F.array(*aspects.values())
    overall = F.when(F.array_contains(statuses, "adjust"), "adjust").when(F.array_contains(statuses, "review"), "review").otherwise("pass")
    return {**aspects, "overall": overall}


def decision(limit: Col, band_: Col, overall: Col, dscr_: Col) -> Column:
    return (
        F.when((col(limit) <= 0) | (col(band_) == BANDS[3]), "reject")
        .when(col(overall) == "adjust", "adjust")
        .when((col(band_) == BANDS[2]) | (col(dscr_) < DSCR_MIN) | (col(overall) == "review"), "conditional")
        .otherwise("approve")
    )


def scorecard(parts: Mapping[str, tuple[Column, float, float]], base: float = -3.05, most: float = 0.60) -> dict[str, Column]:
    """Linear parts (value, weight, centre), each within plus and minus most, through a logistic; reasons by size."""
    each = {n: clip(w * (v - centre), -most, most) for n, (v, w, centre) in parts.items()}
    z = F.lit(base)
    for x in each.values():
        z = z + x
    listed = F.array_sort(F.array(*[F.struct((-F.abs(x)).alias("o"), F.lit(k).alias("i"), F.lit(n).alias("n")) for k, (n, x) in enumerate(each.items())]))
    return {"pd": clip(1 / (1 + F.exp(-z)), 0.0015, 0.60), "reasons": F.transform(listed, lambda x: x["n"])}


def grade_from_dpd(days: Col) -> Column:
    return F.when(col(days) <= 0, 1).when(col(days) <= 90, 2).when(col(days) <= 120, 3).when(col(days) <= 180, 4).when(col(days).isNotNull(), 5)


def month_grid(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each month-end from start to end."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    rows = df.where(F.col(end) >= F.col(start)).withColumn("_m", F.explode(months)).withColumn(name, F.last_day("_m"))
    return rows.where(F.col(name).between(F.col(start), F.col(end))).drop("_m")


def fill_with(measured: Mapping[str, Column], portfolio: Mapping[str, Column]) -> dict[str, Column]:
    """Measured features, else the portfolio's; and where each came from, as text."""
    out = {n: F.coalesce(c, portfolio[n]) for n, c in measured.items()}
    origin = F.concat_ws(",", *[F.concat(F.lit(f"{n}:"), F.when(c.isNotNull(), "document").otherwise("portfolio")) for n, c in measured.items()])
    return {**out, "origins": origin}
