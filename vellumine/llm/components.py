"""Distributed connected components by alternating large and small stars.

Every round replaces links by links to smaller numbers, until each component is
a star around its smallest member. Rounds are written to the shared folder, so
lineage stays short; the driver sees only a count and a checksum a round. Each
task first reduces its own links to a forest. A node that very many others link
to meets aggregates that are made per task first, and its links are dealt to
several tasks when they are joined with its smallest neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.blocks import forest
from vellumine.llm.common import HOT_ROWS, Scratch, hot_join


def _written(scratch: Scratch, links: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    table = scratch.write(links, label)
    state = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(state)


def _least(links: DataFrame, rows: int, scratch: Scratch, label: str) -> DataFrame:
    """Each ``u``'s smallest ``v``, repeated beside all of its links."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if rows <= HOT_ROWS:  # then no node is hot
        return links.join(least, "u")
    return hot_join(links, scratch.write(least, f"{label}-least"), "u", "v", scratch, f"{label}-hubs")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a forest with the components of each batch's links."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        u, v = forest(len(ids), at[: batch.num_rows], at[batch.num_rows :])
        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])


def connected_components(links: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """``links`` (a long, b long) to (id, component): the smallest id reachable.

    Only ids that have a link to another id appear. Links may repeat and run in
    both directions.
    """
    pairs = links.where("a <> b").select("a", "b").mapInArrow(_forests, "u long, v long").distinct()
    table, state = _written(scratch, pairs, f"{label}-0")
    rounds = 0
    while state[0]:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rounds += 1
        large = _least(both, 2 * state[0], scratch, f"{label}-{rounds}-large").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        if 2 * state[0] > HOT_ROWS:
            large = scratch.write(large, f"{label}-{rounds}-stars")
        near = _least(large, 2 * state[0], scratch, f"{label}-{rounds}-small")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        table, found = _written(scratch, small, f"{label}-{rounds}")
        for old in [x for x in scratch.labels if x.startswith(f"{label}-") and x != f"{label}-{rounds}" and x.removeprefix(f"{label}-")[:1].isdigit()]:
            scratch.drop(old)
        if found == state:
            break
        state = found
    return table.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(table.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
