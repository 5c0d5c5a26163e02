"""Operators over events in time: upload batches, backoff, rate limits, pairing, latest runs, bounded caches, kept snapshots.

What depends on neighbours only is a window. What depends on the last event *kept* is a scan in order, with the state of
one key at a time: rows are dealt by key, sorted inside partitions, and read in Arrow batches, so no group is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.relational import newest
from quillon.streaming.sync import worth_keeping


def upload_batches(pending: DataFrame, key: str, content: str, at: str, size: int = 25, most: int = 200) -> DataFrame:
    """Rows waiting to be sent, with the number of their batch: the newest row of each content, of those the newest `most`
    of a key, oldest first in batches of `size`."""
    once = newest(pending.withColumn("_k", F.struct(key, content)), "_k", [F.desc(at)], 1).drop("_k")
    kept = newest(once, key, [F.desc(at), F.desc(content)], most)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(at, content))
    return kept.withColumn("batch", F.floor((turn - 1) / size))


def backoff(failures: Column, first: int = 2, most: int = 300) -> Column:
    """Seconds to wait after so many failures in a row: doubled each time, up to `most`."""
    return F.when(failures <= 0, F.lit(0)).otherwise(F.least(F.lit(most), first * F.pow(F.lit(2), F.least(failures, F.lit(30)) - 1))).cast("long")


def latest_runs(runs: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """Of the runs of a key only the one started last counts."""
    return newest(runs, key, [F.desc(at), F.desc(order)], 1)


def cached(results: DataFrame, key: str, at: str, order: str, most: int = 12) -> DataFrame:
    """The newest results of each key that a bounded cache still holds."""
    return newest(results, key, [F.desc(at), F.desc(order)], most)


def paired(left: DataFrame, right: DataFrame, key: str, at: str, value: str, within: float = 4.0) -> DataFrame:
    """Each row of left with the value of the last row of right at most `within` seconds before it, null if there is none.

    One window over the union of both: no pair of rows is made.
    """
    both = left.select("*", F.lit(1).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[at].dataType).alias("_t"))
    both = both.unionByName(right.select(key, at, F.lit(0).alias("_left"), F.col(value).alias("_v"), F.col(at).alias("_t")), allowMissingColumns=True)
    last = F.last(F.when(F.col("_left") == 0, F.struct("_v", "_t")), ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0))
    near = F.col(at) - F.col("_p")["_t"] <= F.make_dt_interval(secs=F.lit(within))
    return both.withColumn("_p", last).where("_left = 1").select(*left.columns, F.when(near, F.col("_p")["_v"]).alias(value))


def scan_in_order(events: DataFrame, key: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Rows for which step(state, row) -> (state, keep) keeps them, each key's rows in order; state starts as None.

    Memory is a batch and one state. The rows of a key are one sequence, so they are one task's, however many.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            keep = []
            for i, row in enumerate(batch.itertuples(index=False)):
                if now is None or row[names.index(key)] != now[0]:
                    now, state = (row[names.index(key)],), None
                state, taken = step(state, row)
                if taken:
                    keep.append(i)
            yield batch.iloc[keep]

    return events.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limited(events: DataFrame, key: str, at: str, order: str, gap: float, schema: str) -> DataFrame:
    """Events of a key at least `gap` seconds after the last one taken."""
    names = [x.split()[0] for x in schema.split(", ")]
    i, limit = names.index(at), pd.Timedelta(seconds=gap)

    def step(last, row):
        taken = last is None or row[i] - last >= limit
        return (row[i], True) if taken else (last, False)

    return scan_in_order(events, key, [at, order], step, schema)


def kept_snapshots(events: DataFrame, key: str, order: str, schema: str) -> DataFrame:
    """events(key, order, title, reason, text): those that are worth a snapshot, by the rule of `worth_keeping`."""
    names = [x.split()[0] for x in schema.split(", ")]
    title, reason, text = (names.index(x) for x in ("title", "reason", "text"))

    def step(state, row):
        return worth_keeping(state, row[title], row[reason], row[text])

    return scan_in_order(events, key, [order], step, schema)
