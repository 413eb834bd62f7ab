"""Tables kept between the steps of an operator."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words (or rows as small) of the calls that one task takes, where rows are dealt by call.
ROWS = 100_000


@contextmanager
def _dealt(spark: SparkSession) -> Iterator[None]:
    """While this is open, rows dealt by one key of a join count as dealt for the join, and plans aren't changed as they run: how rows of
    such plans lie isn't known any more when they are kept. Methods that are too long to be compiled at run time aren't generated."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.hugeMethodLimit": "8000"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def by_call(df: DataFrame, tasks: int) -> DataFrame:
    """df dealt by call to so many tasks; as it is where it lies so already."""
    return df.repartition(tasks, "call_id")


def kept_by_call(df: DataFrame) -> DataFrame:
    """As kept, of what is made of tables dealt by call: rows stay in their tasks, in joins on the call and further keys and when the table is read again."""
    with _dealt(df.sparkSession):
        return kept(df)


def kept(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir, which driver and executors share (where it isn't set, to a temporary folder, with a local master only)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="turnwise-kept-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with equal keys in one partition, by a shuffle of its own.

    Spark leaves out a repartition by the keys themselves where it takes rows to lie so already; over a union of shuffled tables, whose
    partitions are then merged one by one, they don't.
    """
    return rows.repartition(F.xxhash64(*keys))
