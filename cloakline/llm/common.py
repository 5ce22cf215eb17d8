"""Shared folder, written tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: tab to carriage return, and space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: str | None = None


def column(name: str) -> F.Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def result_names(carried, results) -> list[str]:
    """Names under which carried columns are returned beside results: their own, with docs_ before those that clash."""
    taken, out = {r.lower() for r in results}, []
    for name in carried:
        while name.lower() in taken:
            name = f"docs_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or what SparkContext.setCheckpointDir was told.

    Where neither is set, a local session (one machine) has a temporary folder of its own; a cluster raises, as its
    executors would write to their own disks and the driver would miss their rows.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    told = spark.sparkContext._jsc.sc().getCheckpointDir()
    if told.isDefined():
        return told.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="cloakline-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/cloakline/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: a cut in the lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._cloakline_path = path
    return again


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing reads any more."""
    path = getattr(df, "_cloakline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unit(seed: int, *cols) -> F.Column:
    """A uniform number in [0, 1) that depends on the seed and the columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if where is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about `most` bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b
