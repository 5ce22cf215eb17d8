"""Rows over enough tasks, whatever files they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leaf of a plan that knows no size says a larger one.
UNKNOWN = 1 << 50


def input_bytes(rows: DataFrame) -> int:
    """Size of what the plan reads, as far as it is known without reading."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def spread(rows: DataFrame, *columns: str, each: int) -> DataFrame:
    """rows by the hash of columns, `each` bytes of the input a task, and no fewer tasks than cores.

    A file is read by as many tasks as it has row groups, often one; a task's share of the work, and what it
    holds, is then that of the file. The hash parts equal values nowhere."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(rows) // each))
    return rows.repartition(tasks, *[F.col(c) for c in columns])
