import numpy as np
from pyspark.sql import functions as F

from tamizal.llm import percentiles as P


def test_bound_holds_against_brute_force():
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=50_000), np.repeat(rng.integers(0, 5, 300), 100).astype(float), np.arange(30_000.0)[::-1]):
        parts = []
        for piece in np.array_split(values, 7):
            s = P.Summary(64)
            for few in np.array_split(piece, 5):
                s.add(few)
            parts.append(s.parts())
        whole = P.Summary(64)
        for p in parts:
            whole.merge(np.array(p["tail"]), [(x["level"], x["flip"], np.array(x["vals"])) for x in p["levels"]], p["n"], p["err"])
        w = whole.parts()
        assert w["n"] == len(values) and w["err"] <= len(values) * np.log2(len(values) / 64) / 64
        ordered = np.sort(values)
        probs = [0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
        for q, v in zip(probs, P.quantiles(w["tail"], [(x["level"], x["vals"]) for x in w["levels"]], w["n"], probs)):
            low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
            rank = max(1, np.ceil(q * len(values)))
            assert low - w["err"] <= rank <= high + w["err"]


def test_exact_while_small_and_mergeable(spark):
    rows = [(d, c, float(i % 17)) for d in (1, 2) for c in ("a", None) for i in range(40)] + [(1, "a", None), (1, "a", float("nan")), (1, "b", float("inf"))]
    # columns whose names the operator uses inside
    df = spark.createDataFrame(rows, "day int, c string, x double").withColumn("k0", F.lit("z")).withColumn("v", F.lit(1)).withColumn("part", F.lit(2)).repartition(5)
    days = P.summarize(df, ["day", "c"], "x")
    one = {(r["day"], r["c"]): (r["n"], r["value"], r["rank_error"]) for r in P.percentiles(days, [0.5]).collect()}
    half = sorted(i % 17 for i in range(40))[19]
    assert one == {(1, "a"): (40, half, 0.0), (2, "a"): (40, half, 0.0), (1, None): (40, half, 0.0), (2, None): (40, half, 0.0), (1, "b"): (1, float("inf"), 0.0)}
    both = {r["c"]: (r["n"], r["value"]) for r in P.percentiles(P.merge_summaries(days, ["c"]), [0.5]).collect()}
    assert both["a"] == (80, half)
    small = P.percentiles(P.summarize(df, ["c"], "x", k=8, fan_in=2), [0.5]).where("c = 'a'").first()
    assert abs(sorted(i % 17 for i in range(40) for _ in (0, 1)).index(small["value"]) + 1 - 40) <= small["rank_error"] + 5


def test_empty(spark):
    assert P.summarize(spark.createDataFrame([], "day int, x double"), ["day"], "x").count() == 0
    assert P.percentiles(P.summarize(spark.createDataFrame([(1, None)], "day int, x double"), ["day"], "x"), [0.5]).count() == 0


def test_tree_of_many_summaries(spark):
    values = np.random.default_rng(3).normal(size=20_000)
    df = spark.createDataFrame([(i % 90, "a", float(v)) for i, v in enumerate(values)], "day int, c string, x double")
    days = P.summarize(df, ["day", "c"], "x", k=64)
    whole = P.merge_tree(days, ["c"], k=64, fan_in=4)
    ordered = np.sort(values)
    rows = P.percentiles(whole, [0.05, 0.5, 0.95]).collect()
    assert whole.first()["n"] == 20_000 and len(rows) == 3
    for r in rows:
        assert 0 < r["rank_error"] <= 20_000 * np.log2(20_000 / 64) / 64
        assert abs(np.searchsorted(ordered, r["value"]) + 1 - np.ceil(r["q"] * 20_000)) <= r["rank_error"]
    assert P.merge_tree(days.where("false"), ["c"]).count() == 0
