"""Aggregation per key, per window, and per both. All take frames that may be bounded or streaming where Spark allows it.

groups is any mix of "window" and key columns; with none, one row for all.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rank_at, truncated_mean


def sum_by(df: DataFrame, *groups: str, value: str = "v") -> DataFrame:
    return df.groupBy(*groups).agg(F.sum(value).alias("sum"))


def sum_count(df: DataFrame, *groups: str, value: str = "v") -> DataFrame:
    """A partial state: sum and number of rows."""
    return df.groupBy(*groups).agg(F.sum(value).alias("sum"), F.count(F.lit(1)).alias("n"))


def merge_sum_count(partials: DataFrame, *groups: str) -> DataFrame:
    """Partial states together."""
    return partials.groupBy(*groups).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))


def avg_by(df: DataFrame, *groups: str, value: str = "v", integer: bool = False) -> DataFrame:
    """Mean and count; integer cuts the mean of whole numbers toward zero."""
    mean = truncated_mean(F.sum(value), F.count(value)) if integer else F.avg(value)
    return df.groupBy(*groups).agg(mean.alias("avg"), F.count(F.lit(1)).alias("n"))


def unique(df: DataFrame, *groups: str) -> DataFrame:
    return df.select(*groups).dropDuplicates(list(groups))


def _beside(rows: DataFrame, small: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Each row with its group's row of small; null is a group. Without groups small is one row."""
    if not groups:
        return rows.crossJoin(F.broadcast(small))
    named = small.withColumnsRenamed({g: f"{g}_of_" for g in groups})
    return rows.join(named, reduce(and_, (rows[g].eqNullSafe(named[f"{g}_of_"]) for g in groups))).drop(*(f"{g}_of_" for g in groups))


def _cuts(df: DataFrame, low: Callable, high: Callable, share: float, groups: tuple[str, ...], value: str) -> DataFrame:
    """(groups, n_, cut_, c_, upto_): the distinct values at the ranks low(n) to high(n), about share, of each group of n
    rows, their counts, and how many rows are not above them.

    Quantile sketches bound a narrow band about the rank; of the rows outside it only those below are counted, and of
    those inside only distinct values are put in order. So no group is sorted whole, and a hot one is aggregated by
    many tasks before its counts meet. Nulls are left out.
    """
    eps = 0.001
    least, most = max(0.0, share - eps), min(1.0, share + eps)
    rows = df.where(F.col(value).isNotNull()).select(*groups, value)
    bounds = rows.groupBy(*groups).agg(F.percentile_approx(value, [least, most], 10000).alias("b_"), F.min(value).alias("least_"), F.max(value).alias("most_"), F.count(F.lit(1)).alias("n_"))
    # The sketch's error in ranks is n / 10000; a group of few rows is its own band.
    few = F.col("n_") < 1000
    lo = F.col("least_") if least == 0 else F.when(few, F.col("least_")).otherwise(F.col("b_")[0])
    hi = F.col("most_") if most == 1 else F.when(few, F.col("most_")).otherwise(F.col("b_")[1])
    near = _beside(rows, bounds.select(*groups, "n_", lo.alias("lo_"), hi.alias("hi_")), groups).where(F.col(value) <= F.col("hi_"))
    steps = near.groupBy(*groups, "n_", F.when(F.col(value) >= F.col("lo_"), F.col(value)).alias("cut_")).agg(F.count(F.lit(1)).alias("c_"))
    over = Window.partitionBy(*(groups or ("n_",))).orderBy(F.col("cut_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("upto_", F.sum("c_").over(over))
    return steps.where((F.col("upto_") > low(F.col("n_"))) & (F.col("upto_") - F.col("c_") <= high(F.col("n_"))))


def median_by(df: DataFrame, *groups: str, value: str = "v") -> DataFrame:
    """The middle value, or the mean of the two middle ones. Nulls are left out, and groups without a value on bounded frames."""
    if df.isStreaming:
        return df.groupBy(*groups).agg(F.median(value).alias("median"))
    middle = _cuts(df, lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2), 0.5, groups, value)
    return middle.groupBy(*groups).agg(F.avg("cut_").alias("median"))


def _tied(df: DataFrame, cuts: DataFrame, groups: tuple[str, ...], value: str, tie: str | None) -> DataFrame:
    """The rows whose value is their group's cut, numbered in the order of tie; only they are ranked."""
    equal = _beside(df, cuts, groups).where(F.col(value) == F.col("cut_"))
    return equal.withColumn("rank_", F.row_number().over(Window.partitionBy(*groups, value).orderBy(F.col(tie) if tie else F.lit(0))))


def percentile_by(df: DataFrame, share: float, *groups: str, value: str = "v", tie: str | None = None) -> DataFrame:
    """The record at rank int(n * share), from 0, of each group; ties in the order of the column tie. Nulls are left out."""
    want = lambda n: F.least(rank_at(n, share), n - 1)
    cuts = _cuts(df, want, want, share, groups, value).select(*groups, "cut_", (want(F.col("n_")) - F.col("upto_") + F.col("c_") + 1).alias("at_"))
    return _tied(df, cuts, groups, value, tie).where("rank_ = at_").select(*df.columns)


def top_share_by(df: DataFrame, share: float, *groups: str, value: str = "v", tie: str | None = None, largest: bool = True) -> DataFrame:
    """The int(n * share) largest (or smallest) records of each group; ties in the order of the column tie. Nulls are left out."""
    if largest:
        want = lambda n: n - rank_at(n, share)
        more = rank_at(F.col("n_"), share) - (F.col("n_") - F.col("upto_"))
    else:
        want = lambda n: rank_at(n, share) - 1
        more = rank_at(F.col("n_"), share) - (F.col("upto_") - F.col("c_"))
    cuts = _cuts(df, want, want, 1 - share if largest else share, groups, value).select(*groups, "cut_", more.alias("more_"))
    beyond = F.col(value) > F.col("cut_") if largest else F.col(value) < F.col("cut_")
    return _beside(df, cuts, groups).where(beyond).select(*df.columns).unionByName(_tied(df, cuts, groups, value, tie).where("rank_ <= more_").select(*df.columns))


def percentile_value(df: DataFrame, share: float, *groups: str, value: str = "v") -> DataFrame:
    """The value at rank int(n * share) from a sorted array: the form that streams take, whose windows are held as state."""
    all_ = F.sort_array(F.collect_list(value))
    return df.groupBy(*groups).agg(all_.alias("all_")).select(*groups, F.element_at("all_", F.least(rank_at(F.size("all_"), share).cast("int") + 1, F.size("all_"))).alias(value))


def top_share_values(df: DataFrame, share: float, *groups: str, value: str = "v") -> DataFrame:
    """The int(n * share) largest values from a sorted array: the form that streams take, whose windows are held as state."""
    all_ = F.sort_array(F.collect_list(value), asc=False)
    return df.groupBy(*groups).agg(all_.alias("all_")).select(*groups, F.explode(F.slice("all_", F.lit(1), rank_at(F.size("all_"), share).cast("int"))).alias(value))


def percentile_all(df: DataFrame, share: float, value: str = "v") -> DataFrame:
    """The value at rank int(n * share) of all rows."""
    return percentile_by_hot(df, share, value=value)


def percentile_by_hot(df: DataFrame, share: float, *groups: str, value: str = "v") -> DataFrame:
    """percentile_by's values alone: rows meet their group's bounds once and nothing else."""
    want = lambda n: F.least(rank_at(n, share), n - 1)
    return _cuts(df, want, want, share, groups, value).select(*groups, F.col("cut_").alias(value))


def top_share_by_hot(df: DataFrame, share: float, *groups: str, value: str = "v") -> DataFrame:
    """top_share_by's values alone: all above the cut, and as many equal to it as are wanted, which need no rank."""
    want = lambda n: n - rank_at(n, share)
    cuts = _cuts(df, want, want, 1 - share, groups, value)
    above = _beside(df, cuts, groups).where(F.col(value) > F.col("cut_")).select(*groups, value)
    equal = cuts.withColumn("more_", rank_at(F.col("n_"), share) - (F.col("n_") - F.col("upto_"))).where("more_ > 0")
    part = 10_000  # equal values are made in parts, however many there are
    equal = equal.withColumn("at_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more_") - 1) / part))))
    equal = equal.withColumn("one_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(part).cast("long"), F.col("more_") - F.col("at_") * part))))
    return above.unionByName(equal.select(*groups, F.col("cut_").alias(value)))


def top_count(df: DataFrame, *groups: str, key: str = "k", value: str = "v") -> DataFrame:
    """Sums of every key, ascending inside each window (bounded frames; ties by key)."""
    return df.groupBy(*groups, key).agg(F.sum(value).alias("sum")).orderBy(*groups, "sum", key)


def top_n(df: DataFrame, n: int, *groups: str, value: str = "sum", tie: str = "k") -> DataFrame:
    """The n largest reduced values of each window; ties go to the smaller key. Ranks are limited before the shuffle."""
    order = Window.partitionBy(*groups).orderBy(F.col(value).desc(), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def merge_set(df: DataFrame, *groups: str, value: str = "word") -> DataFrame:
    """Union of the values: the distinct ones, sorted."""
    return df.groupBy(*groups).agg(F.sort_array(F.collect_set(value)).alias("values"))


def merge_bag(df: DataFrame, *groups: str, value: str = "word") -> DataFrame:
    """All values together, as rows (groups, value, n) for each distinct one: what merged vectors hold, without a buffer that
    grows with a window."""
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, *groups: str, value: str = "word", approximate: bool = False) -> DataFrame:
    return df.groupBy(*groups).agg((F.approx_count_distinct(value) if approximate else F.count_distinct(value)).alias("n"))


def at_window_end(df: DataFrame, value: str) -> DataFrame:
    """(t, value) records, stamped with the window's end, for joins on time."""
    return df.select(F.col("window.end").alias("t"), F.col(value).alias("v"))


def reduce_by(df: DataFrame, expression: Callable, *groups: str, **columns: str) -> DataFrame:
    """A reducer of one's own: expression maps a grouped column to an aggregate column."""
    return df.groupBy(*groups).agg(*[expression(F.col(c)).alias(name) for name, c in columns.items()])


def user_aggregate(df: DataFrame, groups: tuple[str, ...], init: Callable, add: Callable, combine: Callable, finish: Callable, schema: str, held: int = 100_000) -> DataFrame:
    """An aggregate of one's own: init() makes a state, add(state, frame) takes a pandas frame of a group's rows in, combine
    joins two states and finish(state) gives a tuple for the columns of schema, which follow the groups.

    Every task sorts its rows by group and folds them into states, at most held at a time, so add is called about once for a
    group of a task; only states are shuffled: a hot group comes together from one state for each task. A task joins the
    states of its groups as they come by, in the groups' order. States are whatever pickle takes; groups are plain columns.
    """
    kinds, names = dict(df.dtypes), list(groups)
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in names)
    outs = df.sparkSession.createDataFrame([], f"{keys}, {schema}").columns

    def flush(states: dict) -> pd.DataFrame:
        return pd.DataFrame([[*k, pickle.dumps(v)] for k, v in states.items()], columns=[*names, "state_"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for frame in frames:
            for key, part in frame.groupby(names, dropna=False, sort=False):
                states[key] = add(states[key] if key in states else init(), part)
            if len(states) > held:
                yield flush(states)
                states = {}
        if states:
            yield flush(states)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, key, state = None, None, None
        for frame in frames:
            rows = []
            for *values, raw in frame[[*names, "state_"]].itertuples(index=False, name=None):
                same = tuple(None if pd.isna(v) else v for v in values)
                if last == same:
                    state = combine(state, pickle.loads(raw))
                    continue
                if last is not None:
                    rows.append([*key, *finish(state)])
                last, key, state = same, values, pickle.loads(raw)
            if rows:
                yield pd.DataFrame(rows, columns=outs)
        if last is not None:
            yield pd.DataFrame([[*key, *finish(state)]], columns=outs)

    # Both zeros are one group, also to the exchange.
    df = df.withColumns({g: F.col(g) + F.lit(0).cast(kinds[g]) for g in names if kinds[g] in ("float", "double")})
    states = df.sortWithinPartitions(*names).mapInPandas(partial, f"{keys}, state_ binary")
    return states.repartition(*names).sortWithinPartitions(*names).mapInPandas(merged, f"{keys}, {schema}")


#: The windowed modes by name: each takes (df, window and key columns, value, share).
MODES: dict[str, Callable[..., DataFrame]] = {
    "SUM_BYKEY": lambda df, groups, value="v", share=None: sum_by(df, *groups, value=value),
    "SUM_ALL": lambda df, groups, value="v", share=None: sum_by(df, "window", value=value),
    "AVG_ALL": lambda df, groups, value="v", share=None: avg_by(df, "window", value=value),
    "AVG_BYKEY": lambda df, groups, value="v", share=None: avg_by(df, *groups, value=value),
    "MEDV_BYKEY": lambda df, groups, value="v", share=None: median_by(df, *groups, value=value),
    "TOPV_BYKEY": lambda df, groups, value="v", share=0.5: (top_share_values if df.isStreaming else top_share_by)(df, share, *groups, value=value),
    "PERCENTILE_BYKEY": lambda df, groups, value="v", share=0.5: (percentile_value if df.isStreaming else percentile_by)(df, share, *groups, value=value),
    "UNIQUE_BYKEY": lambda df, groups, value="v", share=None: unique(df, *groups),
    "TOPCOUNT_BYKEY": lambda df, groups, value="v", share=None: top_count(df, *groups[:-1], key=groups[-1], value=value),
}


def windowed(df: DataFrame, mode: str, *keys: str, value: str = "v", share: float | None = None) -> DataFrame:
    """A mode of MODES over a windowed frame."""
    extra = {} if share is None else {"share": share}
    return MODES[mode](df, ("window", *keys), value, **extra)
