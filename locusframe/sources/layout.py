"""Site tables laid out so that a region is read without the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def write_sorted(rows: DataFrame, path: str, scaffold: str = "scaffold", position: str = "position") -> None:
    """Parquet with a folder per scaffold; files hold ranges of positions, in order.

    Rows are dealt by range, so a long scaffold has many files, and a file's and a row
    group's least and greatest position tell whether a region touches it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, scaffold, position).sortWithinPartitions(scaffold, position).write.mode("overwrite").partitionBy(scaffold).parquet(path)


def read_regions(spark: SparkSession, path: str, regions: list[tuple[str, int | None, int | None]], scaffold: str = "scaffold", position: str = "position") -> DataFrame:
    """Rows of a table of ``write_sorted`` that lie in any of the regions (name, start, end), once each.

    Ends are inclusive, None is open. Only the named scaffolds' folders are listed, and
    position bounds are pushed down to the scan. No regions give no rows.
    """
    fields = spark.read.parquet(path).schema
    # names stay texts: "01" is not 1
    rows = spark.read.schema(StructType([StructField(f.name, StringType() if f.name == scaffold else f.dataType) for f in fields])).parquet(path)

    def inside(name: str, start: int | None, end: int | None) -> Column:
        c = F.col(scaffold) == F.lit(name)
        if start is not None:
            c &= F.col(position) >= F.lit(start)
        return c if end is None else c & (F.col(position) <= F.lit(end))

    hit = F.lit(False)
    for r in regions:
        hit |= inside(*r)
    return rows.where(hit)
