"""Percentiles of very large numeric columns, mergeable, with a bound on the rank error.

Deterministic buffer collapsing. A summary of n values consists of

* a tail: fewer than k raw values (weight 1), and
* at most one full buffer of k sorted values for each level l, in which every
  value stands for 2**l input values.

Two full buffers of one level collapse into one of the next: of their 2k merged
values every second one stays, beginning alternately at the first and at the
second. Summaries are combined by pouring the tails together and collapsing
level by level like a binary counter, so the schedule is a tree and the size is
k * (log2(n / k) + 2) values. One collapse into weight W moves no rank by more
than W / 2; the sum of these over all collapses made is kept with the summary,
and ``rank_error`` of a result is that sum (0 while nothing was collapsed, when
every percentile is exact). Relative to n it is at most log2(n / k) / (2 k).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in a buffer. The error is at most 0.33 % of n up to 2**27 * k = 5.5e11 values of one group.
BUFFER = 4096
#: Summaries that one task combines at most in a round of the tree.
FAN_IN = 64

SUMMARY = "tail array<double>, levels array<struct<level:int, flip:boolean, vals:array<double>>>, n bigint, err double"


class Summary:
    """The summary of one group; see the module's text."""

    __slots__ = ("err", "flip", "full", "k", "n", "tail")

    def __init__(self, k: int = BUFFER) -> None:
        self.k, self.n, self.err = k, 0, 0.0
        self.tail: np.ndarray = np.empty(0)
        self.full: dict[int, np.ndarray] = {}
        self.flip: dict[int, bool] = {}

    def add(self, values: np.ndarray) -> None:
        """Count values (no null, no NaN) in."""
        self.n += len(values)
        self._pour(values)

    def merge(self, tail: np.ndarray, levels: Iterable[tuple[int, bool, np.ndarray]], n: int, err: float) -> None:
        """Count another summary in, given by its parts."""
        self.n += n
        self.err += err
        for level, flip, vals in levels:
            self.flip[level] = self.flip.get(level, False) ^ flip
            if len(vals):
                self._carry(level, vals)
        self._pour(tail)

    def _pour(self, values: np.ndarray) -> None:
        raw = np.concatenate([self.tail, values]) if len(self.tail) else values
        whole = len(raw) // self.k * self.k
        for start in range(0, whole, self.k):
            self._carry(0, np.sort(raw[start : start + self.k]))
        self.tail = np.array(raw[whole:])

    def _carry(self, level: int, vals: np.ndarray) -> None:
        while level in self.full:
            both = np.sort(np.concatenate([self.full.pop(level), vals]), kind="stable")
            first = self.flip.get(level, False)
            self.flip[level] = not first
            vals = both[int(first) :: 2]
            level += 1
            self.err += 2.0 ** (level - 1)
        self.full[level] = vals

    def parts(self) -> dict:
        levels = [{"level": x, "flip": self.flip.get(x, False), "vals": self.full.get(x, np.empty(0)).tolist()} for x in sorted({*self.full, *(i for i, f in self.flip.items() if f)})]
        return {"tail": np.sort(self.tail).tolist(), "levels": levels, "n": self.n, "err": self.err}


def quantiles(tail: Sequence[float], levels: Iterable[tuple[int, Sequence[float]]], n: int, probs: Sequence[float]) -> list[float | None]:
    """The values of rank ceil(p * n) (at least 1) as far as a summary tells them; None for no values."""
    if not n:
        return [None] * len(probs)
    vals = [np.asarray(tail, dtype=float)]
    weights = [np.ones(len(vals[0]))]
    for level, own in levels:
        vals.append(np.asarray(own, dtype=float))
        weights.append(np.full(len(own), 2.0**level))
    v, w = np.concatenate(vals), np.concatenate(weights)
    order = np.argsort(v, kind="stable")
    v, upto = v[order], np.cumsum(w[order])
    at = np.searchsorted(upto, [max(1, math.ceil(round(p * n, 9))) for p in probs], side="left")
    return [float(v[min(i, len(v) - 1)]) for i in at]


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ") if x]


def summarize(df: DataFrame, keys: Sequence[str], value: str, k: int = BUFFER, fan_in: int = FAN_IN) -> DataFrame:
    """One mergeable summary per group of keys: columns keys, tail, levels, n, err.

    Null and NaN values are left out, every other value of every row counts
    (also infinite ones and repeated rows). A null key is a group of its own. A group without
    any counted value, like an empty table, yields no row. Columns besides keys and value aren't read, so their names
    can't clash. Values are summarized inside each input partition, and only
    summaries move; they are combined in rounds of at most fan_in for a task, so
    one group may hold all rows.
    """
    own = [f"k{i}" for i in range(len(keys))]
    src = df.select(*(F.col(c).alias(o) for c, o in zip(keys, own)), F.col(value).cast("double").alias("v"))
    src = src.where(F.col("v").isNotNull() & ~F.isnan("v"))
    kinds = dict(src.dtypes)
    key_ddl = ", ".join(f"{o} {kinds[o]}" for o in own)
    parts = src.rdd.getNumPartitions()
    part_schema = f"part int, {key_ddl}, {SUMMARY}"

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, Summary] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in table.group_by(own).aggregate([("v", "list")]).to_batches():
                groups = list(zip(*(row.column(o).to_pylist() for o in own)))
                lists = row.column("v_list")
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                for i, group in enumerate(groups):
                    if group not in held:
                        held[group] = Summary(k)
                    held[group].add(flat[offsets[i] : offsets[i + 1]])
        rows = [{"part": part, **dict(zip(own, group)), **s.parts()} for group, s in held.items()]
        for start in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[start : start + 256], schema=arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    probe = df.sparkSession.createDataFrame([], part_schema)
    arrow_schema = to_arrow_schema(probe.schema, prefers_large_types=False)
    out = src.mapInArrow(per_partition, part_schema)
    while True:
        parts = math.ceil(parts / fan_in)
        out = merge_summaries(out.withColumn("part", (F.col("part") / fan_in).cast("int")), ["part", *own], k)
        if parts <= 1:
            break
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, keys)), "tail", "levels", "n", "err")


def merge_tree(summaries: DataFrame, keys: Sequence[str], k: int = BUFFER, fan_in: int = FAN_IN) -> DataFrame:
    """Like merge_summaries, for groups of any number of summaries: in rounds that combine some fan_in for each task.

    summaries is read twice (first the greatest number in a group is counted) and should be a written table. A summary's
    place in the tree follows from its content, so a task that is repeated does the same.
    """
    most = summaries.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    out = summaries.select(*keys, "tail", "levels", "n", "err")
    parts = math.ceil(most / fan_in)
    while parts > 1:
        part = F.pmod(F.xxhash64("n", "err", "tail", F.lit(parts)), F.lit(parts)).alias("part_")
        out = merge_summaries(out.select(*keys, part, "tail", "levels", "n", "err"), [*keys, "part_"], k).drop("part_")
        parts = math.ceil(parts / fan_in)
    return merge_summaries(out, keys, k)


def merge_summaries(summaries: DataFrame, keys: Sequence[str], k: int = BUFFER) -> DataFrame:
    """Combine all summaries of each group of keys into one; the result is again mergeable."""
    own = [f"g{i}" for i in range(len(keys))]
    src = summaries.select(*(F.col(c).alias(o) for c, o in zip(keys, own)), "tail", "levels", "n", "err")
    kinds = dict(src.dtypes)

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        s = Summary(k)
        rows = []
        for batch in table.select(["tail", "levels", "n", "err"]).to_batches():
            tails, levels = batch.column("tail"), batch.column("levels")
            numbers = zip(batch.column("n").to_pylist(), batch.column("err").to_pylist())
            rows += [(-n, err, tails[i].values.to_numpy(zero_copy_only=False), levels[i].values) for i, (n, err) in enumerate(numbers)]
        for n, err, tail, own_levels in sorted(rows, key=lambda r: (r[0], r[1], r[2].tobytes())):
            level, flip, vals = (own_levels.field(x) for x in ("level", "flip", "vals"))
            s.merge(tail, [(x, f, vals[i].values.to_numpy(zero_copy_only=False)) for i, (x, f) in enumerate(zip(level.to_pylist(), flip.to_pylist()))], -n, err)
        return pa.Table.from_pylist([{**{o: v.as_py() for o, v in zip(own, key)}, **s.parts()}], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = ", ".join(f"{o} {kinds[o]}" for o in own) + f", {SUMMARY}"
    schema = to_arrow_schema(df_schema(summaries, ddl), prefers_large_types=False)
    merged = src.groupBy(*own).applyInArrow(combine, ddl)
    return merged.select(*(F.col(o).alias(c) for o, c in zip(own, keys)), "tail", "levels", "n", "err")


def df_schema(df: DataFrame, ddl: str):
    return df.sparkSession.createDataFrame([], ddl).schema


def percentiles(summaries: DataFrame, probs: Sequence[float]) -> DataFrame:
    """A row for each summary and probability: q, value, and rank_error, the bound on the rank's error.

    The value's true rank lies within rank_error of ceil(q * n).
    """
    probs = list(probs)

    @F.pandas_udf("array<double>")
    def read(tail, levels, n):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([quantiles(t, [(x["level"], x["vals"]) for x in ls], int(m), probs) for t, ls, m in zip(tail, levels, n)])

    kept = [c for c in summaries.columns if c not in ("tail", "levels", "err")]
    values = summaries.select(*kept, F.col("err").alias("rank_error"), read("tail", "levels", "n").alias("found"))
    pairs: Column = F.arrays_zip(F.array(*(F.lit(p) for p in probs)).alias("q"), F.col("found").alias("value"))
    out = values.select(*kept, "rank_error", F.explode(pairs).alias("x"))
    return out.select(*kept, F.col("x.q").alias("q"), F.col("x.value").alias("value"), "rank_error")
