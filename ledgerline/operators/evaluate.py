"""Statistics of scores and predictions: exact, with ties, as aggregations over distinct scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.functions import null_if_zero
from ledgerline.operators.graph import cut
from ledgerline.operators.quantiles import row_of
from ledgerline.operators.windows import average_rank, running_sum


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score from the highest: rows, events, and both so far with the totals."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    each = rows.groupBy((-F.col(score)).alias("_o"), F.col(score).alias("score")).agg(F.sum(label).alias("events"), F.count("*").alias("n"))
    both = running_sum(running_sum(each, ["_o"], "events", "events_so_far"), ["_o"], "n", "n_so_far")
    total = rows.agg(F.sum(label).alias("events_all"), F.count("*").alias("n_all"))
    return both.crossJoin(F.broadcast(total)).drop("_o")


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The chance that an event outranks another row, ties by half; Gini with it.  One row, or one a group."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    each = rows.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    if by:
        below = F.coalesce(F.sum("q").over(W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        each = each.withColumn("below", below)
    else:
        each = running_sum(each, ["_s"], "q", "below").withColumn("below", F.col("below") - F.col("q"))
    auc = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / null_if_zero(F.sum("p") * F.sum("q"))
    out = (each.groupBy(*by) if by else each).agg(auc.alias("auc")) if by else each.agg(auc.alias("auc"))
    return out.withColumn("gini", 2 * F.col("auc") - 1)


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    tpr = F.col("events_so_far") / null_if_zero("events_all")
    fpr = (F.col("n_so_far") - F.col("events_so_far")) / null_if_zero(F.col("n_all") - F.col("events_all"))
    return curve(df, score, label).agg(F.max(F.abs(tpr - fpr)).alias("ks"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    gained = F.col("events") / null_if_zero("events_all") * F.col("events_so_far") / F.col("n_so_far")
    return curve(df, score, label).agg(F.sum(gained).alias("average_precision"))


def losses(score: str, label: str, floor: float = 1e-6) -> list[Column]:
    p, y = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(score))), F.col(label)
    return [F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss")]


def confusion(score: Column, label: Column, threshold: Column, weight: Sequence[str] = ()) -> dict[str, Column]:
    """Counts and rates at a threshold, as aggregates."""
    hit, y = score >= threshold, label == 1
    tp, fp, fn, tn = (F.count_if(x).cast("double") for x in (hit & y, hit & ~y, ~hit & y, ~hit & ~y))
    n = tp + fp + fn + tn
    precision, recall, specificity = tp / null_if_zero(tp + fp), tp / null_if_zero(tp + fn), tn / null_if_zero(tn + fp)
    f = lambda b: (1 + b * b) * precision * recall / null_if_zero(b * b * precision + recall)
    return {
        "tp": tp, "fp": fp, "tn": tn, "fn": fn, "accuracy": (tp + tn) / null_if_zero(n), "balanced": (recall + specificity) / 2, "precision": precision, "recall": recall,
        "specificity": specificity, "npv": tn / null_if_zero(tn + fn), "f1": f(1), "f2": f(2), "fpr": fp / null_if_zero(fp + tn), "fnr": fn / null_if_zero(fn + tp), "alert_rate": (tp + fp) / null_if_zero(n),
        "mcc": (tp * tn - fp * fn) / null_if_zero(F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
    }


def threshold_min_recall(df: DataFrame, score: str, label: str, recall: float) -> DataFrame:
    """The score of the highest precision among those whose recall is enough (the highest of equal ones)."""
    rows = curve(df, score, label).select("score", (F.col("events_so_far") / F.col("n_so_far")).alias("precision"), (F.col("events_so_far") / null_if_zero("events_all")).alias("recall"))
    return rows.where(F.col("recall") >= recall).orderBy(F.col("precision").desc(), F.col("score").desc()).limit(1)


def band_table(df: DataFrame, band: str, score: str, label: str) -> DataFrame:
    """Per band: rows, events, rate, mean and bounds of the score, share of rows and of events."""
    rows = df.groupBy(band).agg(F.count("*").alias("rows"), F.sum(label).alias("events"), F.avg(label).alias("rate"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"))
    every = W.partitionBy()  # one row a band
    return rows.withColumns({"share": F.col("rows") / F.sum("rows").over(every), "captured": F.col("events") / null_if_zero(F.sum("events").over(every))})


def capture(df: DataFrame, score: str, tie: str, label: str, fractions: Sequence[float]) -> DataFrame:
    """Per fraction of the highest scores: events captured, precision and lift."""
    from ledgerline.operators.rows import add_row_id

    ranked = add_row_id(df.select((-F.col(score)).alias("_o"), tie, label), "rank", ["_o", tie])
    n = df.agg(F.count("*").alias("n"), F.sum(label).alias("e"))
    rows = ranked.crossJoin(F.broadcast(n)).select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).where("rank <= ceil(n * fraction)")
    hits = F.sum(label)
    return rows.groupBy("fraction").agg((hits / null_if_zero(F.first("e"))).alias("capture"), (hits / F.count("*")).alias("precision"), (hits / F.count("*") / null_if_zero(F.first("e") / F.first("n"))).alias("lift"))


def psi(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability over the quantiles of the expected values."""
    edges = row_of(expected, {"edges": value}, [i / bins for i in range(1, bins)]).select(F.array_distinct("edges").alias("edges"))
    share = lambda df, name: (
        df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.size(F.filter("edges", lambda e: e < F.col(value))).alias("bin")).agg(F.count("*").alias("_n"))
        .withColumn(name, F.col("_n") / F.sum("_n").over(W.partitionBy())).select("bin", name)
    )
    both = share(expected, "a").join(share(actual, "b"), "bin", "full")
    a, b = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor)) for x in ("a", "b"))
    return both.agg(F.sum((b - a) * F.log(b / a)).alias("psi"))


def spearman(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(x, y, rho) of each pair of columns by average ranks."""
    ranked = df.select(key, *columns)
    for c in columns:
        ranked = average_rank(ranked, c, f"_r_{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return ranked.agg(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(f"_r_{a}", f"_r_{b}").alias("rho")) for a, b in pairs]).alias("m")).select(F.inline("m"))


def regression(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: mean absolute and squared error, its root, the share explained, bias and the 90th percentile of the error's size."""
    e = predicted - actual
    mse = F.avg(e * e)
    means = [F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - mse / null_if_zero(F.var_pop(actual))).alias("r2"), F.avg(e).alias("bias")]
    return df.agg(*means).crossJoin(F.broadcast(row_of(df, {"p90": F.abs(e)}, [0.9]).select(F.col("p90")[0].alias("p90"))))


def bootstrap_auc(df: DataFrame, scores: Sequence[str], label: str, key: str, draws: int = 5000, seed: int = 7) -> DataFrame:
    """(draw, auc of each score) over resamples: the same rows for all scores.

    A row stands in a draw as often as a Poisson variable of mean 1 says that is a hash of the draw and the row's key, so
    a rerun takes the same rows, nothing is joined, and what is shuffled is one sum for each draw and distinct score.
    """
    rows = df.where(F.col(label).isNotNull()).select(key, label, *scores)
    steps, total, chance = [], 0.0, math.exp(-1)
    for k in range(1, 12):
        total += chance
        steps.append(total)
        chance /= k
    u = F.pmod(F.xxhash64("draw", key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", times).where("_w > 0")
    out = None
    for s in scores:
        each = drawn.where(F.col(s).isNotNull()).groupBy("draw", F.col(s).alias("_s")).agg(F.sum(F.col("_w") * F.col(label)).alias("p"), F.sum(F.col("_w") * (1 - F.col(label))).alias("q"))
        below = F.coalesce(F.sum("q").over(W.partitionBy("draw").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        auc = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / null_if_zero(F.sum("p") * F.sum("q"))
        one = each.withColumn("below", below).groupBy("draw").agg(auc.alias(f"auc_{s}"))
        out = one if out is None else out.join(one, "draw")
    return out


def resampled_auc(df: DataFrame, scores: Sequence[str], label: str, draws: int = 5000, seed: int = 7, most: int = 4_000_000, size: int | None = None) -> DataFrame:
    """(draw, auc_ of each score) over resamples within each class, so that a draw has as many events as the rows: the same for all scores.

    Rows are first counted by their scores and class.  A draw is one multinomial count for each of those, by a generator
    of its number, so draws are dealt to tasks and a rerun gives the same; no row meets a draw.  The counts go to every
    task: about 8 bytes a score and distinct row; over `most` of them it is an error, unless `size` is given: then no task
    sees more than about `size` of them (see ranged_auc).  Rows without a label or any score are left out; one class alone
    has no AUC.
    """
    rows = df.where(F.col(label).isNotNull())
    for s in scores:
        rows = rows.where(F.col(s).isNotNull())
    counts = cut(rows.groupBy(*[F.col(s).cast("double").alias(s) for s in scores], (F.col(label) == 1).alias("_y")).agg(F.count("*").alias("_n")))
    found = counts.count()
    if found > most and size is not None:
        return ranged_auc(counts, scores, -(-found // size), draws, seed)
    if found > most:
        raise ValueError(f"there are more than {most} different rows of scores")
    table = counts.toArrow()
    values, y, n = [table.column(s).to_numpy() for s in scores], table.column("_y").to_numpy(zero_copy_only=False).astype(bool), table.column("_n").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast((values, y, n))
    names = ["draw", *[f"auc_{s}" for s in scores]]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, y, n = sent.value
        orders = [np.argsort(v, kind="stable") for v in values]
        edges = [np.flatnonzero(np.concatenate(([True], v[o][1:] != v[o][:-1]))) for v, o in zip(values, orders, strict=True)] if len(n) else []
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for draw in batch.column(0).to_pylist():
                times = resample_counts(y, n, np.random.default_rng([seed, draw]))
                out[0].append(draw)
                for k, order in enumerate(orders):
                    out[k + 1].append(_auc_of(times[order], y[order], edges[k]) if len(n) else None)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.float64()) for x in out[1:])], names=names)

    numbers = df.sparkSession.range(draws).select(F.col("id").alias("draw")).repartition(max(1, draws // 100))
    return numbers.mapInArrow(drawn, ", ".join(f"{x} {'long' if x == 'draw' else 'double'}" for x in names))


def ranged_auc(counts: DataFrame, scores: Sequence[str], k: int, draws: int, seed: int) -> DataFrame:
    """resampled_auc over counts (the scores, _y, _n) that are too many for one task: the same distribution by another generator.

    Each score is cut at k - 1 of its percentiles; a range is one of these values, or what lies between two of them.  A cell
    is what lies in one range of each score and is of one class.  A draw is one multinomial count for each cell, by a
    generator of the draw, and so many picks from the cell's rows, by a generator of draw and cell: so a task that holds a
    range of one score draws the same rows as another that holds a range of another score.  An AUC is then made up of what
    ranges hold within and of their totals, a few numbers a range and draw.
    """
    spark = counts.sparkSession
    marks = [sorted(set(x or [])) for x in counts.agg(*[F.percentile_approx(s, [i / k for i in range(1, k)] or [0.5], 100 * k) for s in scores]).first()]
    wide = [2 * len(m) + 1 for m in marks]  # even: between two marks, odd: a mark itself
    place = lambda s, m: 2 * F.size(F.filter(F.array(*map(F.lit, m)), lambda x: x < F.col(s))) + F.array_contains(F.array(*map(F.lit, m)), F.col(s)).cast("int")
    ranged = counts.select("*", *[(place(s, m) if m else F.lit(0)).alias(f"_r{i}") for i, (s, m) in enumerate(zip(scores, marks, strict=True))])
    code = F.lit(0).cast("long")
    for i, w in enumerate(wide):
        code = code * w + F.col(f"_r{i}")
    ranged = cut(ranged.select("*", (code * 2 + F.col("_y").cast("long")).alias("_c")))
    table = ranged.groupBy("_c", *[f"_r{i}" for i in range(len(scores))]).agg(F.sum("_n").alias("n")).orderBy("_c").toArrow()
    cells, n = table.column("_c").to_numpy(), table.column("n").to_numpy()
    y, ranges = cells % 2 == 1, [table.column(f"_r{i}").to_numpy() for i in range(len(scores))]
    sent = spark.sparkContext.broadcast((cells, n, y, ranges))
    schema = "score int, draw long, range int, within double, p long, q long"

    def rows_of(values: Sequence[Sequence]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["score", "draw", "range", "within", "p", "q"])

    def at_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the ranges of one value only the totals count."""
        cells, n, y, ranges = sent.value
        for batch in batches:
            for draw in batch.column(0).to_pylist():
                times = resample_counts(y, n, np.random.default_rng([seed, draw]))
                for i, r in enumerate(ranges):
                    both = [np.bincount(r[side], times[side], wide[i])[1::2] for side in (y, ~y)]
                    if len(both[0]):
                        yield rows_of([[i] * len(both[0]), [draw] * len(both[0]), list(range(1, wide[i], 2)), (both[0] * both[1] / 2).tolist(), *(x.astype(np.int64) for x in both)])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one range of one score, the cells one after the other."""
        cells, n, y, ranges = sent.value
        for (i, r, share), own in groupby(chain.from_iterable(map(_runs, batches)), key=lambda x: x[0]):
            c, v, times = (np.concatenate(x) for x in zip(*(x for _, x in own), strict=True))
            distinct, rank = np.unique(v, return_inverse=True)
            starts, distinct_at = np.flatnonzero(np.diff(c, prepend=-1)), rank.astype(np.int32)
            picks = [(cell, np.repeat(distinct_at[a:b], times[a:b])) for cell, a, b in zip(np.searchsorted(cells, c[starts]), starts, [*starts[1:], len(c)], strict=True)]
            out: list[list] = [[] for _ in range(6)]
            for draw in range(share, draws, shares):
                counted = resample_counts(y, n, np.random.default_rng([seed, draw]))
                drawn: dict[bool, list[np.ndarray]] = {True: [distinct_at[:0]], False: [distinct_at[:0]]}
                for cell, to in picks:
                    if counted[cell]:
                        drawn[bool(y[cell])].append(to[np.random.default_rng([seed, draw, cell]).integers(0, len(to), counted[cell], np.int32)])
                p, q = (np.bincount(np.concatenate(drawn[side]), minlength=len(distinct)) for side in (True, False))
                for x, value in zip(out, (i, draw, r, float((p * (np.cumsum(q) - q / 2)).sum()), int(p.sum()), int(q.sum())), strict=True):
                    x.append(value)
            yield rows_of(out)

    shares = min(draws, max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(scores) * k))))
    each = [F.struct(F.lit(i).alias("i"), F.col(f"_r{i}").alias("r"), F.col(s).alias("v")) for i, s in enumerate(scores)]
    dealt = ranged.select("_c", "_n", *scores, F.explode(F.array(*each)).alias("x")).where("x.r % 2 = 0").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = dealt.select(F.col("x.i").alias("i"), F.col("x.r").alias("r"), "share", "_c", F.col("x.v").alias("v"), "_n", *scores).repartition(len(scores) * k * shares, "i", "r", "share").sortWithinPartitions("i", "r", "share", "_c", *scores)
    parts = cut(dealt.select("i", "r", "share", "_c", "v", "_n").mapInArrow(between, schema).unionByName(spark.range(draws).repartition(max(1, draws // 100)).mapInArrow(at_marks, schema)))
    below = F.coalesce(F.sum("q").over(W.partitionBy("score", "draw").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = parts.withColumn("won", F.col("within") + F.col("p") * below).groupBy("score", "draw").agg((F.sum("won") / null_if_zero(F.sum("p").cast("double") * F.sum("q"))).alias("auc"))
    return won.groupBy("draw").agg(*[F.max(F.when(F.col("score") == i, F.col("auc"))).alias(f"auc_{s}") for i, s in enumerate(scores)])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """((i, r, share), (_c, v, _n)) of the rows of a batch that follow each other with the same first three."""
    i, r, share, c, v, n = (x.to_numpy() for x in batch.columns)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(i)), bool), (np.diff(i) != 0) | (np.diff(r) != 0) | (np.diff(share) != 0))))
    for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
        yield (int(i[a]), int(r[a]), int(share[a])), (c[a:b], v[a:b], n[a:b])


def resample_counts(y: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How often each of the distinct rows stands in a resample; each class keeps its total."""
    times = np.zeros(len(n), dtype=np.int64)
    for side in (y, ~y):
        if side.any():
            times[side] = rng.multinomial(n[side].sum(), n[side] / n[side].sum())
    return times


def _auc_of(times: np.ndarray, y: np.ndarray, edges: np.ndarray) -> float | None:
    """The AUC of counted rows in order of their score; edges is where each distinct score begins."""
    p, q = np.add.reduceat(times * y, edges), np.add.reduceat(times * ~y, edges)
    pairs = float(p.sum()) * float(q.sum())
    return float((p * (np.cumsum(q) - q / 2)).sum() / pairs) if pairs else None


def matrix_shifts(source: DataFrame, gold: DataFrame) -> DataFrame:
    """Pair by pair (x, y, rho) of two correlation matrices: both values, the shift, whether the sign flips, and the place by size of the shift."""
    both = source.select("x", "y", F.col("rho").alias("source")).join(gold.select("x", "y", F.col("rho").alias("gold")), ["x", "y"])
    shift = F.col("gold") - F.col("source")
    rows = both.select("*", shift.alias("shift"), (F.signum("source") != F.signum("gold")).alias("flipped"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.abs("shift").desc(), "x", "y")))  # one row a pair of columns


def matrix_drift(source: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the correlation of the two matrices' entries, the mean size of a shift, and how many of how many signs flip."""
    return matrix_shifts(source, gold).agg(F.corr("source", "gold").alias("agreement"), F.avg(F.abs("shift")).alias("mean_shift"), F.count_if("flipped").alias("flipped"), F.count("*").alias("pairs"))


def cluster_events(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: rows, events, their rate, share of all events and lift over all rows; the riskiest has the highest rate (ties by name)."""
    each = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("events"), F.avg(label).alias("rate"))
    every = W.partitionBy()  # one row a cluster
    events, rows = F.sum("events").over(every), F.sum("n").over(every)
    return each.withColumns({"captured": F.col("events") / null_if_zero(events), "lift": F.col("rate") / null_if_zero(events / rows), "riskiest": F.row_number().over(every.orderBy(F.col("rate").desc(), cluster)) == 1})


def group_folds(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, fold): groups in order of their events, dealt to folds there and back, so that events are balanced."""
    from ledgerline.operators.rows import add_row_id

    sizes = df.groupBy(group).agg(F.coalesce(F.sum(label), F.lit(0)).alias("events"))
    ranked = add_row_id(sizes.withColumns({"_o": -F.col("events"), "_h": F.md5(F.col(group).cast("string"))}), "_i", ["_o", "_h", group], 0)
    lap, at = F.floor(F.col("_i") / k), F.col("_i") % k
    return ranked.select(group, F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two groupings: adjusted Rand index and normalised mutual information."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda n: n * (n - 1) / 2
    side = lambda x: cells.groupBy(x).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(f"s_{x}"), F.sum(-F.col("m") * F.log("m")).alias(f"h_{x}"))
    all_ = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("j"))
    x = all_.crossJoin(side(a)).crossJoin(side(b))
    t, expected = F.col("t"), F.col(f"s_{a}") * F.col(f"s_{b}") / two(F.col("t"))
    ari = (F.col("s") - expected) / null_if_zero((F.col(f"s_{a}") + F.col(f"s_{b}")) / 2 - expected)
    ha, hb = F.col(f"h_{a}") / t + F.log(t), F.col(f"h_{b}") / t + F.log(t)
    mutual = F.col("j") / t + ha + hb - F.log(t)
    return x.select(ari.alias("ari"), (2 * mutual / null_if_zero(ha + hb)).alias("nmi"))
