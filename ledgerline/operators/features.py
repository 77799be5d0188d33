"""Model features resolved from facts: by hand, direct, by name, by alias or by a formula over facts and other features."""

from __future__ import annotations

from collections.abc import Sequence
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Feature(NamedTuple):
    """A feature's name and kind (double, integer, boolean), other names of the fact, and an SQL formula over the names in needs."""

    name: str
    kind: str = "double"
    aliases: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    formula: str = ""


#: Where a fact comes from: set by hand for the feature, set by hand as a fact, read as the feature, read as a fact.
LAYERS = ("manual_feature", "manual", "direct", "fact")


def normal_name(name: Column) -> Column:
    """Lower case, blanks, hyphens and slashes as one underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s/-]+", "_")


def ordered(features: Sequence[Feature]) -> list[Feature]:
    """The features such that each comes after those that its formula needs; formulas in a circle are an error."""
    by_name = {f.name: f for f in features}
    try:
        return [by_name[n] for n in TopologicalSorter({f.name: [n for n in f.needs if n in by_name] for f in features}).static_order()]
    except CycleError as e:
        raise ValueError(f"formulas need each other: {' -> '.join(e.args[1])}") from e


def resolve(facts: DataFrame, key: str, features: Sequence[Feature]) -> DataFrame:
    """(key, feature, value, source, formula) of every feature that has a value, one row each.

    facts: key, layer, name, value; of equal ones the largest value counts, names are compared in their normal form.  The
    first that there is of: by hand for the feature; a fact by hand of its name; read as the feature; a fact of its name; a
    fact of the first alias that has one (by hand before read); the formula, if all it needs has a value.  What a formula
    needs is another feature, as resolved, or else a fact.  A formula without a value (a division by nothing) gives none.
    """
    order = ordered(features)
    own = {f.name for f in features}
    raw = {n for f in features for n in (f.name, *f.aliases, *(x for x in f.needs if x not in own))}
    layered = [(layer, n) for n in sorted(raw) for layer in (("manual", "fact") if n not in own else LAYERS)]
    cell = lambda layer, n: f"{layer}:{n}"
    at = lambda layer, n: F.col(f"`{cell(layer, n)}`")
    name = normal_name(F.col("name"))
    df = facts.groupBy(key).agg(*[F.max(F.when((F.col("layer") == layer) & (name == n), F.col("value"))).alias(cell(layer, n)) for layer, n in layered])
    df = df.withColumns({n: F.coalesce(at("manual", n), at("fact", n)) for n in sorted(raw - own)})

    def found(value: Column, source: str) -> Column:
        return F.when(value.isNotNull(), F.struct(value.cast("double").alias("value"), F.lit(source).alias("source")))

    for f in order:
        ways = [found(at(layer, f.name), {"manual_feature": "manual feature", "manual": "manual fact", "direct": "direct", "fact": "fact"}[layer]) for layer in LAYERS]
        ways += [found(at(layer, a), f"alias {a}" if layer == "fact" else f"alias {a}, manual") for a in f.aliases for layer in ("manual", "fact")]
        if f.formula:
            ways.append(found(F.expr(f.formula), "formula"))
        best = F.coalesce(*ways)
        value = {"integer": best["value"].cast("long").cast("double"), "boolean": (best["value"] != 0).cast("double")}.get(f.kind, best["value"])
        df = df.withColumns({f.name: value, f"{f.name}:source": best["source"]})  # a step of its own, so that a formula is worked out once
    rows = [F.struct(F.lit(f.name).alias("feature"), F.col(f"`{f.name}`").alias("value"), F.col(f"`{f.name}:source`").alias("source"), F.when(F.col(f"`{f.name}:source`") == "formula", F.lit(f.formula)).alias("formula")) for f in features]
    return df.select(key, F.inline(F.array(*rows))).where(F.col("value").isNotNull())


def completeness(resolved: DataFrame, keys: DataFrame, key: str, features: Sequence[Feature]) -> DataFrame:
    """Of each key how many of the features have a value, their share, and the names of those that have none."""
    names = F.array(*[F.lit(f.name) for f in features])
    found = resolved.groupBy(key).agg(F.collect_set("feature").alias("_there"))
    there = F.coalesce("_there", F.array().cast("array<string>"))
    return keys.join(found, key, "left").select(key, F.size(there).cast("long").alias("observed"), F.round(F.size(there) / len(features), 4).alias("share"), F.array_except(names, there).alias("missing"))
