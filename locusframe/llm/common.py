"""Helpers that the operators share: checkpoints, checked broadcasts, components."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20  # bytes of texts that kernels take at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A temporary one only where that is unset and executors run in the driver's own
    process, as in tests; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="locusframe-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    pad = ""
    while any((n + pad).lower() in taken for n in names):
        pad += "_"
    return [n + pad for n in names]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the folder all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Without the hint Spark shuffles both sides and splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (src, dst): rows (node, root).

    ``root`` is the least node that can be reached; nodes without an edge are not
    listed. Alternates large-star and small-star steps, each a partial aggregation
    and a join, so that no neighbourhood is ever gathered in one task. The lineage
    is cut after every round. An empty graph gives no rows; loops and repeated
    edges change nothing; edges with a null end are dropped.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = edges.where("src <> dst").select(pair(F.col("src"), F.col("dst")).alias("e")).select("e.u", "e.v").distinct()
    e = checkpoint(e)
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def string_bytes(column: pa.Array):
    """The bytes of a string column's chunk and where each text starts and ends."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray):
    """Ranges of texts of about CHUNK bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
