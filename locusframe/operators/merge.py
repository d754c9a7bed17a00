"""Merging several genotype tables by site: intersect, union, all positions, semi.

The tables are tagged and united, so that any number of them costs one shuffle by
site instead of a chain of joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE = ["scaffold", "position"]


def merge_sites(tables: list[DataFrame], how: str = "intersect", union_min: int = 1, first: int = 0, missing: str = "N", lengths: DataFrame | None = None, silent=()) -> DataFrame:
    """Sites of tables (scaffold, position, gt) with columns gt_0, gt_1, ...

    ``intersect``: in all tables; ``union``: in ``union_min`` tables or more and in each
    of the ``first`` tables named first; ``all``: every position of ``lengths``
    (scaffold, length). Absent calls are ``missing``. Tables numbered in ``silent`` take
    part without giving a column. Of a table's repeated sites the least call counts.
    """
    tagged = reduce(DataFrame.unionByName, [t.select(*SITE, F.lit(i).alias("t"), "gt") for i, t in enumerate(tables)])
    n = len(tables)
    cells = [F.min(F.when(F.col("t") == i, F.struct("gt")))["gt"].alias(f"gt_{i}") for i in range(n)]
    m = tagged.groupBy(*SITE).agg(*cells, *[F.max((F.col("t") == i).cast("int")).alias(f"has_{i}") for i in range(n)])
    present = sum((F.col(f"has_{i}") for i in range(n)), F.lit(0))
    if how == "intersect":
        m = m.where(present == n)
    elif how == "union":
        ok = present >= max(union_min, first)
        for i in range(first):
            ok &= F.col(f"has_{i}") == 1
        m = m.where(ok)
    else:
        every = lengths.select("scaffold", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"))).alias("position"))
        m = every.join(m, SITE, "left")
    return m.select(*SITE, *[F.coalesce(f"gt_{i}", F.lit(missing)).alias(f"gt_{i}") for i in range(n) if i not in silent])


def dedup_sites(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with the same site the first by ``order``."""
    best = rows.groupBy(*SITE).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in SITE]), F.col(order)).alias("x"))
    return best.select(*SITE, "x.*")
