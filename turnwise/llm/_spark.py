"""Checkpoints, streamed groups and connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it isn't set, a temporary folder, if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="turnwise-checkpoint-")


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Rows of a batch that Spark hands to Python where rows hold whole texts or sequences; each batch lies in both at once.
TEXT_ROWS = 2_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """While this is open, what is run hands Python batches of so many rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_STORES: dict[str, dict] = {}


def store(name: str) -> dict:
    """What a Python worker keeps from task to task under this name."""
    return _STORES.setdefault(name, {})


def give_back(own: str | None = None) -> None:
    """In a task: memory that was freed goes back to the system, with all stores but the step's own. A Python worker serves one step after the other,
    and what it once held counts for all."""
    for name, held in _STORES.items():
        if name != own:
            held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that a task may hold (8 bytes each); beyond that they are joined by a shuffle.
HELD_IDS = 1_000_000


def only(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose `on` is (left_anti: isn't) in ids, a kept table; broadcast if the count of ids is within HELD_IDS."""
    ids = ids.select(on)
    return df.join(F.broadcast(ids) if ids.count() <= HELD_IDS else ids, on, how)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by integer keys; a group is never cut."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if carry:
            last = carry[-1]
            change[0] = any(last.column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns))
        cuts = np.flatnonzero(change)
        if not len(cuts):
            carry.append(batch)
            continue
        if ready := [*carry, *([batch.slice(0, cuts[-1])] if cuts[-1] else [])]:
            yield pa.Table.from_batches(ready).combine_chunks()
        carry = [batch.slice(cuts[-1])]
    if carry:
        yield pa.Table.from_batches(carry).combine_chunks()


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table sorted by keys, and the number of rows."""
    change = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        change[1:] = np.logical_or.reduce([(c := table.column(k).to_numpy())[1:] != c[:-1] for k in keys])
    return np.append(np.flatnonzero(change), table.num_rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), longs; the component is its smallest node.

    Each round takes the least label of the neighbours and then the label's own label, so that paths shrink
    by half at least; the rows of a round are edges and nodes, and nothing comes to the driver but a count.
    """
    both = kept(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        labels = kept(step.join(upper, "label", "left").select("node", "old", F.least("label", F.coalesce("upper", "label")).alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
