"""Buckets of any size as cells of bounded size.

A bucket of more than a block's rows is dealt to blocks by hash, and every pair
of blocks becomes a cell. Two members of a bucket meet in exactly one cell; no
task ever holds more than two blocks of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import Scratch, keyed_side


def cells(entries: DataFrame, keys: list[str], member: str, block: int, scratch: Scratch, label: str, weight: str | None = None, spread: int = 1, fine: int = 1) -> DataFrame:
    """``entries`` with ``cell`` (long), ``own`` and ``other`` (block numbers).

    Rows of a cell with ``own == other`` meet one another; in other cells rows of
    different ``own`` meet. A block has about ``block`` rows, or so much of ``weight``;
    a smaller bucket is dealt to at most ``spread`` blocks, of ``fine`` at least.
    """
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    large = scratch.write(entries.groupBy(*keys).agg(total.alias("total")).select(*keys, F.greatest(F.ceil(F.col("total") / block), F.least(F.lit(spread), F.ceil(F.col("total") / fine))).cast("int").alias("blocks")).where("blocks > 1"), label)
    dealt = entries.join(keyed_side(large), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member, F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.withColumn("cell", F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")))


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, recut so that no key's rows lie in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(values, values[-1], side="left"))
        if last == 0 and (not held or held[-1].column(key)[-1].as_py() == values[0]):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(values))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, smallest member reachable from i) of a graph of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            at = np.flatnonzero(label != np.arange(n))
            return at, label[at]
