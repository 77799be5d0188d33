"""Column expressions: cleaning, dates, ratios, bins and credit arithmetic.  All are built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- money, ratios, bounds
def parse_money(c: Col) -> Column:
    """'$1,234.00 ' to 1234.0; what is no number becomes null."""
    return F.regexp_replace(F.trim(col(c)), r"[^0-9.\-]", "").try_cast("double")


def null_if_zero(c: Col) -> Column:
    return F.when(col(c) != 0, col(c))


def clip(c: Col, low: float | None = None, high: float | None = None) -> Column:
    """Bounded values; null stays null (least and greatest alone would turn it into a bound)."""
    out = col(c)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(col(c).isNotNull(), out)


def safe_ratio(num: Col, den: Col, cap: float | None = 1e6) -> Column:
    """num / den, null where den is zero or null, within plus and minus cap."""
    ratio = col(num) / null_if_zero(den)
    return clip(ratio, -cap, cap) if cap else ratio


def positive(c: Col) -> Column:
    return F.when(col(c) > 0, col(c))


def reconciliation_gap(paid: Col, received: Col) -> Column:
    return F.abs(col(paid) - col(received)) / null_if_zero(paid)


def log_weight(c: Col) -> Column:
    return F.log1p(clip(c, 0.0))


def convert(amount: Col, currency: Col, rates: Mapping[str, float], to_local: float) -> Column:
    """Amounts in a common currency by fixed rates; an unknown currency counts as 1."""
    return col(amount) * F.coalesce(lookup(currency, rates), F.lit(1.0)) * to_local


# ---------------------------------------------------------------- text
def clean(c: Col, case: str = "upper", zero_pad: int = 0) -> Column:
    """Trimmed, in one case, and padded with zeros where shorter (lpad alone would cut longer ones)."""
    out = F.trim(col(c))
    out = {"upper": F.upper, "lower": F.lower}.get(case, lambda x: x)(out)
    return F.when(F.length(out) < zero_pad, F.lpad(out, zero_pad, "0")).otherwise(out) if zero_pad else out


def null_sentinels(c: Col, words: Sequence[str] = ("", "-", "n/a", "null", "none", "tidak ada", "\\n")) -> Column:
    return F.when(~F.lower(F.trim(col(c))).isin(*words), col(c))


def parse_local_number(c: Col) -> Column:
    """Numbers of Indonesian or English grouping; parentheses are negative, a percent sign divides by 100.

    With both marks the last one is the decimal mark.  With one kind of mark it groups if it stands more than once or
    is followed by exactly three digits.
    """
    text = F.regexp_replace(F.trim(col(c)), r"[^0-9.,()%\-]", "")
    minus = text.rlike(r"^\(.*\)") | text.startswith("-")
    digits = F.regexp_replace(text, r"[()%\-]", "")
    english, local = F.replace(digits, F.lit(","), F.lit("")), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    both = F.contains(digits, F.lit(",")) & F.contains(digits, F.lit("."))
    plain = (
        F.when(both & (F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")), local)
        .when(both, english)
        .when(digits.rlike(r"^\d{1,3}(,\d{3})+$"), english)
        .when(F.contains(digits, F.lit(",")), local)
        .when(digits.rlike(r"^\d{1,3}(\.\d{3})+$"), local)
        .otherwise(digits)
    )
    value = plain.try_cast("double")
    value = F.when(F.contains(text, F.lit("%")), value / 100).otherwise(value)
    return F.when(minus, -value).otherwise(value)


def classify(c: Col, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule of which a word occurs in the text."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out: Column | None = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def composite_key(*cols: Col) -> Column:
    return F.concat_ws("-", *[col(c).cast("string") for c in cols])


def format_id(prefix: str, c: Col, width: int = 6) -> Column:
    return F.format_string(f"{prefix}-%0{width}d", col(c))


# ---------------------------------------------------------------- dates
def parse_date(c: Col, pattern: str) -> Column:
    """A date by a pattern, null where it does not parse.

    Two-digit years from 69 on belong to the last century, as in the C library.
    """
    parsed = F.try_to_timestamp(col(c), F.lit(pattern)).cast("date")
    if "yyyy" in pattern:
        return parsed
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def month_end(c: Col) -> Column:
    return F.last_day(col(c))


def previous_month_end(c: Col) -> Column:
    """The last day before the month of c: what was known when the month began."""
    return F.date_sub(F.trunc(col(c), "month"), 1)


def month_bucket(c: Col) -> Column:
    return F.trunc(col(c), "month")


def days_between(later: Col, earlier: Col) -> Column:
    return F.datediff(col(later), col(earlier))


def active_at(at: Col, start: Col = "valid_from", end: Col = "valid_to") -> Column:
    """Valid at a time: from start on, up to but without end; a null end is open."""
    return (col(start) <= col(at)) & (col(end).isNull() | (col(end) > col(at)))


# ---------------------------------------------------------------- maps, bins, grades
def lookup(c: Col, values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[col(c)]


def map_lookup(c: Col, values: Mapping[str, object], default: object) -> Column:
    return F.coalesce(lookup(c, values), F.lit(default))


def bin_fixed(c: Col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the first edge that is at least the value; beyond the last edge the last label."""
    out = F.when(col(c) <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(col(c) <= edge, label)
    return out.when(col(c).isNotNull(), labels[len(edges)]) if len(labels) > len(edges) else out


def ordinal(c: Col, order: Sequence[str]) -> Column:
    """Place in an order from 1; null for what is not in it."""
    return null_if_zero(F.array_position(F.array(*map(F.lit, order)), col(c)))


def names_where(**flags: Column) -> Column:
    """The names of the flags that are true, as an array."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


# ---------------------------------------------------------------- statements
TAX_RATE, INTEREST_FLOOR, DAYS_CAP = 0.22, 0.01, 720.0


def derive_interest(ebit: Col, net_income: Col, liabilities: Col) -> Column:
    """Interest that pre-tax income implies, at least a share of liabilities; null if that is zero."""
    implied = col(ebit) - col(net_income) / (1 - TAX_RATE)
    return null_if_zero(F.when(implied.isNotNull() & col(liabilities).isNotNull(), F.greatest(implied, INTEREST_FLOOR * clip(liabilities, 0.0))))


def rebuild_ebitda(net_income: Col, *added: Col) -> Column:
    """Net income and what is added back, if there is any of it."""
    total, some = col(net_income), F.lit(False)
    for c in added:
        total, some = total + F.coalesce(col(c), F.lit(0.0)), some | col(c).isNotNull()
    return F.when(col(net_income).isNotNull() & some, total)


def financial_ratios() -> dict[str, Column]:
    """Ratios over the columns assets, liabilities, current_assets, current_liabilities, long_term_debt, inventory,
    receivables, retained, revenue, cogs, gross_profit, ebit, ebitda, net_income and depreciation."""
    c = F.col
    equity, debt, cash = c("assets") - c("liabilities"), c("long_term_debt") + c("current_liabilities"), c("net_income") + c("depreciation")
    interest = derive_interest("ebit", "net_income", "liabilities")
    dso, dio = safe_ratio("receivables", "revenue") * 365, safe_ratio("inventory", "cogs") * 365
    return {
        "equity": equity,
        "der_total": safe_ratio("liabilities", positive(equity)),
        "der_interest": safe_ratio("long_term_debt", positive(equity)),
        "debt_to_ebitda": safe_ratio(debt, positive("ebitda")),
        "icr_ebit": safe_ratio("ebit", interest),
        "icr_ebitda": safe_ratio("ebitda", interest),
        "roa": safe_ratio("net_income", "assets"),
        "operating_margin": safe_ratio("ebit", "revenue"),
        "gross_margin": safe_ratio("gross_profit", "revenue"),
        "current_ratio": safe_ratio("current_assets", "current_liabilities"),
        "quick_ratio": safe_ratio(c("current_assets") - c("inventory"), "current_liabilities"),
        "asset_turnover": safe_ratio("revenue", "assets"),
        "wc_to_ta": safe_ratio(c("current_assets") - c("current_liabilities"), "assets"),
        "re_to_ta": safe_ratio("retained", "assets"),
        "cfo_to_ebitda": safe_ratio(cash, positive("ebitda")),
        "dso_days": dso,
        "dio_days": dio,
        "cycle_days": clip(dso + dio, 0.0, DAYS_CAP),
    }
