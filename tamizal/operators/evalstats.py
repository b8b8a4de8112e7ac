"""Scoring and statistics of question banks and runs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.session import materialize


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with upto, the sum of value over the rows of the same by up to this one in the order (which must be total).

    Rows are cut into ranges of by and order, summed up inside these, and the sums of the ranges before are added, so one by
    that holds most rows is spread over many tasks. Only a sum for each range and by is put in order in one place.
    """
    cut = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in (*by, *order))).withColumn("range_", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    sums = cut.groupBy(*by, "range_").agg(F.sum(value).alias("sum_"))
    earlier = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(c).alias(f"{c}_by") for c in by), F.col("range_").alias("range_by"), F.sum("sum_").over(earlier).alias("earlier_"))
    inside = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("range_") == F.col("range_by")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_by"))
    out = cut.withColumn("upto", F.sum(value).over(inside)).join(sums, same, "left")
    return out.withColumn("upto", F.col("upto") + F.coalesce("earlier_", F.lit(0))).drop("range_", "range_by", "earlier_", *(f"{c}_by" for c in by))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes, median (middle two) and nearest-rank percentiles, and the upper median; NaN counts as missing.

    Exact: equal values are counted before they move, and ranks are running counts over ranges of values.
    """
    src = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    out = src.groupBy(*by).agg(F.count("v").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"))
    ranked = running(src.groupBy(*by, "v").agg(F.count("*").alias("c")), by, ["v"], "c").select(*(F.col(x).alias(f"{x}_r") for x in by), "v", "c", "upto")
    same = F.lit(True)
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_r"))
    n = F.col("n")
    # the rank of each wanted value among the sorted ones, from 1
    places = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1} | {f"p{round(q * 100)}": F.greatest(F.lit(1), F.ceil(F.round(q * n, 9))) for q in (0.9, 0.95, 0.99)}
    each = out.join(ranked, same).groupBy(*by, *out.columns[len(by) :]).agg(*(F.max(F.when((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at), F.col("v"))).alias(name) for name, at in places.items()))
    return each.select(*out.columns, F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p90", "p95", "p99", F.col("high").alias("upper_median"))


def shares(df: DataFrame, by: Sequence[str], part: str, value: str) -> DataFrame:
    """Sum of value by part and its share of the total, for each combination of by and over all (grouping sets)."""
    sums = df.groupingSets([[F.col(c) for c in (*by, part)], [F.col(part)]], *(F.col(c) for c in (*by, part))).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.withColumn("share", F.round(F.col("total").cast("double") / F.sum("total").over(Window.partitionBy(*by)).cast("double"), 6))


def confusion(df: DataFrame, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    """Counts of each pair of labels, zeros included; null guesses are left out of the matrix."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} string, {guess} string")
    counts = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, [truth, guess], "left").select(truth, guess, F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each label that occurs, 0 where undefined."""
    t = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.sum(F.coalesce((F.col(truth) == F.col(guess)).cast("int"), F.lit(0))).alias("hits"))
    g = df.where(F.col(guess).isNotNull()).groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("guesses"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = t.join(g, "label", "full").select("label", zero("support").alias("support"), zero("hits").alias("hits"), zero("guesses").alias("guesses"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("guesses")), ratio(F.col("hits"), F.col("support"))
    return both.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters over rows that both rated; 1 if chance alone agrees."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    n = both.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"))
    chance = both.groupBy(F.col("a").alias("r")).agg(F.count("*").alias("x")).join(both.groupBy(F.col("b").alias("r")).agg(F.count("*").alias("y")), "r").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pe = F.coalesce(F.col("xy"), F.lit(0)) / (F.col("n") * F.col("n"))
    return n.crossJoin(F.broadcast(chance)).select("n", F.round("po", 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided McNemar p of the two discordant counts: twice the smaller binomial tail, at most 1."""
    n, k = (only_a + only_b).cast("int"), F.least(only_a, only_b).cast("int")
    first = F.struct(F.exp(-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), k), first, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(df: DataFrame, key: str, group: str, good: str) -> DataFrame:
    """Each pair of groups compared on the keys both have: counts of keys only one got right, and the exact p."""
    x = df.select(F.col(key).alias("k"), F.col(group).alias("a"), F.col(good).alias("ga"))
    y = df.select(F.col(key).alias("k"), F.col(group).alias("b"), F.col(good).alias("gb"))
    pairs = x.join(y, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum((F.col("ga") & ~F.col("gb")).cast("int")).alias("only_a"), F.sum((~F.col("ga") & F.col("gb")).cast("int")).alias("only_b"))
    return pairs.withColumn("p", F.round(mcnemar_p(F.col("only_a"), F.col("only_b")), 6))


#: Shares of a Poisson(1) variable's values 0, 1, 2, .. summed up, in parts of 2**31.
POISSON = tuple(round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) * 2**31) for k in range(12))


def counts_of(h: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """How often each row (a number from its key) is drawn in each resample: Poisson(1) counts from a fixed mix that any engine with 64-bit integers can repeat."""
    t = (h[:, None] + reps[None, :] * 40_503 + seed * 7_919) % 2**31
    for _ in range(3):
        t = (t * 1_103_515_245 + 12_345) % 2**31
        t ^= t >> 16
    return np.searchsorted(np.array(POISSON), t, side="right")


def bootstrap(df: DataFrame, by: str, key: str, value: str, reps: int = 10_000, seed: int = 1) -> DataFrame:
    """Mean and percentile interval (2.5 %, 97.5 %) of value over resampled keys for each by.

    Each row draws its own count for every resample, so rows stay where they are and what moves is two sums
    for each partition, by and resample.
    """
    src = df.select(F.col(by).cast("string").alias("g"), F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint").alias("h"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(reps, dtype=np.int64)
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            h, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            groups = batch.column(0).to_pylist()
            for g in set(groups):
                times, sums = held.setdefault(g, (np.zeros(reps), np.zeros(reps)))
                mine = np.flatnonzero([x == g for x in groups])
                for first in range(0, len(mine), 64):
                    part = mine[first : first + 64]
                    c = counts_of(h[part], every, seed)
                    times += c.sum(0)
                    sums += v[part] @ c
        for g, (times, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * reps, pa.string()), pa.array(every.astype(np.int32)), pa.array(times), pa.array(sums)], names=["g", "rep", "times", "sums"])

    means = src.mapInArrow(run, "g string, rep int, times double, sums double").groupBy("g", "rep").agg(F.try_divide(F.sum("sums"), F.sum("times")).alias("m"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("m", "rep")) - 1
    ends = means.withColumn("at", place).groupBy("g").agg(F.round(F.max(F.when(F.col("at") == int(0.025 * reps), F.col("m"))), 6).alias("low"), F.round(F.max(F.when(F.col("at") == int(0.975 * reps), F.col("m"))), 6).alias("high"))
    sizes = df.where(F.col(value).isNotNull()).groupBy(F.col(by).cast("string").alias("g")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"))
    return sizes.join(ends, "g").select(F.col("g").alias(by), "n", "mean", "low", "high")


def wilcoxon(df: DataFrame, by: Sequence[str], difference: str) -> DataFrame:
    """Signed-rank sums of non-zero differences, W, the rank-biserial effect, Z and |Z|/sqrt(n) without tie correction, and the two-sided p.

    Differences of one size are counted before they are ranked, and share the mean of their ranks. p is exact up to 50 differences without ties, else by
    the normal approximation with tie correction.
    """
    d = df.where(F.col(difference).isNotNull() & ~F.isnan(difference) & (F.col(difference) != 0)).select(*by, F.abs(F.col(difference)).alias("size"), (F.col(difference) > 0).cast("int").alias("up"))
    ranked = running(d.groupBy(*by, "size").agg(F.count("*").alias("c"), F.sum("up").alias("up")), by, ["size"], "c")
    rank = F.col("upto") - (F.col("c") - 1) / 2
    ties = F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c"))
    s = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (F.col("c") - F.col("up"))).alias("w_minus"), ties.alias("ties"))
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    spread = n * (n + 1) * (2 * n + 1) / 24
    z = (w - n * (n + 1) / 4) / F.sqrt(spread)
    p = F.when((F.col("n") <= 50) & (F.col("ties") == 0), _exact_p(F.col("n"), w)).otherwise(F.least(F.lit(1.0), 2 * normal_tail(F.abs(w - n * (n + 1) / 4) / F.sqrt(spread - F.col("ties") / 48))))
    return s.select(*by, "n", "w_plus", "w_minus", w.alias("w"), F.round((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")), 6).alias("rank_biserial"), F.round(z, 6).alias("z"), F.round(F.abs(z) / F.sqrt(n), 6).alias("effect_r"), F.round(p, 4).alias("p"))


def normal_tail(z: Column) -> Column:
    """The share of a standard normal variable above z >= 0, by the complementary error function's rational form (error below 1.2e-7)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # fixed values: the coefficients of the form, from the highest power
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = series * t + c
    return 0.5 * t * F.exp(-x * x + series)


def _exact_p(n: Column, w: Column) -> Column:
    @F.pandas_udf("double")
    def p(sizes, sums):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([wilcoxon_exact_p(int(a), float(b)) if a <= 50 else None for a, b in zip(sizes, sums)], dtype="float64")

    return p(n, w)


def wilcoxon_exact_p(n: int, w: float) -> float:
    """Exact two-sided p of the signed-rank sum without ties, by counting rank subsets."""
    counts = [1]
    for r in range(1, n + 1):
        counts = [a + b for a, b in zip(counts + [0] * r, [0] * r + counts)]
    return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)


def holm(df: DataFrame, by: Sequence[str], p: str, key: str) -> DataFrame:
    """df with adjusted: Holm's step-down p within by, never falling along the order of p, at most 1."""
    w = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = F.col(p) * (m - F.row_number().over(w) + 1)
    return df.withColumn("raw", raw).withColumn("adjusted", F.round(F.least(F.lit(1.0), F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))), 6)).drop("raw")


def adjudicated(df: DataFrame, a: str, b: str, resolved: str) -> DataFrame:
    """df with rating: the resolved one where given, else the common one; fails if raters differ and nothing is resolved."""
    rating = F.coalesce(F.col(resolved), F.when(F.col(a) == F.col(b), F.col(a)))
    return df.withColumn("rating", F.when(rating.isNotNull(), rating).otherwise(F.raise_error(F.lit("raters differ and no resolution is given")).cast("string")))


def within_budget(df: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, limit: float) -> DataFrame:
    """Rows whose running cost within by stays in the limit, with that sum: it stops before the first that would exceed it. Costs aren't negative."""
    return running(df, by, order, cost).withColumnRenamed("upto", "spent").where(F.col("spent") <= limit)


def multiset_overlap(expected: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """For each key, how many of the expected items (with repeats) are found."""
    e = expected.groupBy(key, item).agg(F.count("*").alias("e"))
    f = found.groupBy(key, item).agg(F.count("*").alias("f"))
    return e.join(f, [key, item], "left").groupBy(key).agg(F.sum("e").alias("expected"), F.sum(F.least(F.col("e"), F.coalesce("f", F.lit(0)))).alias("matched")).withColumn("share", F.round(F.col("matched") / F.col("expected"), 6))


def stratified(df: DataFrame, by: str, key: str, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows of each stratum in key order, or with a seed in the order of a hash of seed and key. Each partition keeps n rows of a stratum before any move."""
    order = F.col(key) if seed is None else F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(key)))).where(F.col("rank") <= n)


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, how often it occurs and its rank: the mean of the places that equal values take."""
    ranked = running(df.groupBy(*by, value).agg(F.count("*").alias("c")), by, [value], "c")
    return ranked.select(*by, value, F.col("c").alias("times"), (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def human_scores(ratings: DataFrame, item: str, system: str, a: str, b: str, resolved: str, good: str = "correct", lenient: Sequence[str] = ("correct", "partial"), reps: int = 5_000) -> DataFrame:
    """By system: rated items, strict and lenient accuracy after adjudication, the strict one's interval, and the raters' kappa."""
    rated = adjudicated(ratings, a, b, resolved)
    strict, loose = (F.col("rating") == good).cast("double"), F.col("rating").isin(*lenient).cast("double")
    shares_ = rated.groupBy(system).agg(F.count("*").alias("items"), F.round(F.avg(strict), 6).alias("strict"), F.round(F.avg(loose), 6).alias("lenient"))
    ends = bootstrap(rated.select(system, item, strict.alias("good")), system, item, "good", reps).select(system, "low", "high")
    both = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.groupBy(system).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"))
    x = both.groupBy(system, F.col(a).alias("r")).agg(F.count("*").alias("x"))
    y = both.groupBy(system, F.col(b).alias("r")).agg(F.count("*").alias("y"))
    chance = x.join(y, [system, "r"]).groupBy(system).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pe = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    k = n.join(chance, system, "left").select(system, F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))
    return shares_.join(ends, system).join(k, system, "left")


def same_conditions(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """Settings (key, value) that two runs' manifests don't share: key, first, second; none if the runs are comparable."""
    x, y = a.select(key, F.col("value").alias("first")), b.select(key, F.col("value").alias("second"))
    return x.join(y, key, "full").where(~F.col("first").eqNullSafe(F.col("second")))


def override_simulation(df: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """By true category: rows, and how many were right before and after an override, mended and spoilt by it."""
    right = lambda c: F.coalesce(F.col(c) == F.col(truth), F.lit(False))
    count = lambda c: F.sum(c.cast("int"))
    return df.groupBy(truth).agg(F.count("*").alias("rows"), count(right(before)).alias("right_before"), count(right(after)).alias("right_after"), count(~right(before) & right(after)).alias("mended"), count(right(before) & ~right(after)).alias("spoilt"))


def with_defaults(wanted: DataFrame, found: DataFrame, keys: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """wanted with the columns of found by keys; where there is no row, or no value, the default stands."""
    both = wanted.join(found.select(*keys, *defaults), list(keys), "left")
    return both.select(*wanted.columns, *(F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()))


def stage_profile(df: DataFrame, stage: str, value: str) -> DataFrame:
    """By stage: runs, mean and population deviation of value, and its share of the sum of all stages."""
    v = F.when(~F.isnan(value), F.col(value))
    s = df.groupBy(stage).agg(F.count(v).alias("n"), F.round(F.avg(v), 9).alias("mean"), F.round(F.stddev_pop(v), 9).alias("deviation"), F.sum(v).alias("sum"))
    whole = s.agg(F.sum("sum").alias("whole"))
    return s.crossJoin(F.broadcast(whole)).select(stage, "n", "mean", "deviation", F.round(F.col("sum") / F.col("whole"), 9).alias("share"))  # of one row


def promotable(df: DataFrame, needed: Sequence[str], unique: str, verified: Column | None = None) -> DataFrame:
    """df itself, if no needed field is missing, unique has no value twice and all rows are verified; else reading it fails."""
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    twice = F.count("*").over(Window.partitionBy(unique)) > 1
    reason = F.when(missing, "a field is missing").when(twice & F.col(unique).isNotNull(), "a value stands twice").when(~F.coalesce(verified, F.lit(False)) if verified is not None else F.lit(False), "a row isn't verified")
    checked = df.withColumn("reason_", reason)
    return checked.withColumn(unique, F.when(F.col("reason_").isNull(), F.col(unique)).otherwise(F.raise_error(F.concat(F.col("reason_"), F.lit(": "), F.coalesce(F.col(unique).cast("string"), F.lit("null")))).cast(dict(df.dtypes)[unique]))).drop("reason_")
