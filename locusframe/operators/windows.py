"""Genomic windows: by coordinate, by site count, predefined, blocks.

Windows are a table; sites meet them by the number of the window, which follows from
the position, in an equi-join. Ranks within a scaffold come from counts per stretch
and ranks inside a stretch, so no scaffold is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.intervals import points_in_intervals

STRETCH = 1_000_000


def last_positions(sites: DataFrame) -> DataFrame:
    return sites.groupBy("scaffold").agg(F.max("position").alias("last"))


def _last_number(size: int, step: int):
    return F.greatest(F.lit(0), F.ceil((F.col("last") - size) / step)).cast("long")


def coordinate_windows(sites: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """All windows [1 + k step, size + k step]: window_id, scaffold, k, start, end.

    A scaffold's last window is the first that reaches its last site; windows without
    sites are listed. Ids count from 1 over scaffolds in name order.
    """
    step = step or size
    w = last_positions(sites).withColumn("_k", _last_number(size, step))
    # one row per scaffold
    w = w.withColumn("_before", F.sum(F.col("_k") + 1).over(Window.orderBy("scaffold")) - F.col("_k") - 1)
    w = w.select("scaffold", "_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k"))).alias("k"))
    return w.select((F.col("_before") + F.col("k") + 1).alias("window_id"), "scaffold", "k", (F.col("k") * step + 1).alias("start"), (F.col("k") * step + size).alias("end"))


def in_coordinate_windows(rows: DataFrame, size: int, step: int | None = None, sites: DataFrame | None = None) -> DataFrame:
    """``rows`` with the number ``k`` of each coordinate window they lie in."""
    step = step or size
    ends = last_positions(rows if sites is None else sites)
    lo = F.greatest(F.lit(0), F.ceil((F.col("position") - size) / step)).cast("long")
    hi = F.least(_last_number(size, step), F.floor((F.col("position") - 1) / step)).cast("long")
    x = rows.join(F.broadcast(ends) if ends.limit(100_001).count() <= 100_000 else ends, "scaffold")
    return x.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi))).drop("last")


def window_summary(windows: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """windows with sites, first and last site and the half-even mean position ``mid``."""
    s = placed.groupBy(*keys).agg(
        F.count("*").alias("sites"), F.min("position").alias("first_site"), F.max("position").alias("last_site"), F.bround(F.avg("position")).cast("long").alias("mid")
    )
    return windows.join(s, keys, "left").withColumn("sites", F.coalesce("sites", F.lit(0).cast("long")))


def ranked(sites: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``sites`` with ``rn``, the rank by position within the scaffold, from 0."""
    s = sites.withColumn("_s", F.floor(F.col("position") / stretch))
    n = s.groupBy("scaffold", "_s").count()
    n = n.withColumn("_before", F.sum("count").over(Window.partitionBy("scaffold").orderBy("_s")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("scaffold", "_s").orderBy("position")) - 1
    return s.withColumn("_in", inside).join(n, ["scaffold", "_s"]).withColumn("rn", (F.col("_before") + F.col("_in")).cast("long")).drop("_s", "_in", "_before")


def site_windows(sites: DataFrame, size: int, overlap: int = 0, min_sites: int | None = None) -> DataFrame:
    """Windows of ``size`` sites: scaffold, i, start, end, mid, sites; shorter tails if allowed."""
    step = size - overlap
    r = ranked(sites)
    n = r.groupBy("scaffold").agg(F.count("*").alias("n"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("rn") - size + 1) / step)).cast("long")
    hi = F.least(F.floor(F.col("rn") / step), F.greatest(F.lit(0), F.ceil((F.col("n") - overlap) / step) - 1)).cast("long")
    x = r.join(n, "scaffold").where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    w = x.groupBy("scaffold", "i").agg(F.min("position").alias("start"), F.max("position").alias("end"), F.bround(F.avg("position")).cast("long").alias("mid"), F.count("*").alias("sites"))
    return w.where(F.col("sites") >= (size if min_sites is None else min_sites))


def max_distance_windows(positions: list[int], size: int, overlap: int, max_dist: int, min_sites: int) -> list[tuple[int, int]]:
    """(first, last) indices of greedy windows of up to ``size`` sites within ``max_dist``.

    A window grows until it has ``size`` sites or the next lies too far from its first. If
    it has ``min_sites`` it is kept and the next starts with its last ``overlap`` sites;
    else, and where that would not advance, one site is dropped on the left.
    """
    out, a, n = [], 0, len(positions)
    end = -1
    while a < n:
        z = a
        while z + 1 < n and z + 1 - a < size and positions[z + 1] - positions[a] <= max_dist:
            z += 1
        if z - a + 1 >= min_sites and z > end:
            out.append((a, z))
            end = z
            if z == n - 1:
                break
            a = max(a + 1, z + 1 - overlap)
        else:
            a += 1
    return out


def site_windows_max_distance(sites: DataFrame, size: int, overlap: int, max_dist: int, min_sites: int) -> DataFrame:
    """The windows of ``max_distance_windows`` per scaffold: start, end, sites.

    The scan depends on every step before; a scaffold's positions go to one task.
    """
    import pandas as pd

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        p = sorted(pdf["position"])
        w = max_distance_windows(p, size, overlap, max_dist, min_sites)
        return pd.DataFrame({"scaffold": [pdf["scaffold"].iloc[0]] * len(w), "i": range(len(w)), "start": [p[a] for a, _ in w], "end": [p[z] for _, z in w], "sites": [z - a + 1 for a, z in w]})

    return sites.select("scaffold", "position").groupBy("scaffold").applyInPandas(scan, "scaffold string, i long, start long, end long, sites long")


def predefined_windows(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (wname, scaffold, start, end) with their sites and mid, empty ones too.

    A window is its name, scaffold and ends together, as names may be missing (NA) or repeat.
    """
    keys = ["wname", "scaffold", "start", "end"]
    placed = points_in_intervals(sites.select("scaffold", "position"), windows.select(*keys).distinct())
    return window_summary(windows, placed.select(*keys, "position"), keys)


def blocks(sites: DataFrame, size: int) -> DataFrame:
    """Non-overlapping blocks of ``size`` sites, the tail included."""
    r = ranked(sites).withColumn("block", F.floor(F.col("rn") / size))
    return r.groupBy("scaffold", "block").agg(F.count("*").alias("sites"), F.min("position").alias("start"), F.max("position").alias("end"))


def jackknife_blocks(sites: DataFrame, width: int) -> DataFrame:
    """``sites`` with ``block``, counted in ``width`` from the scaffold's first site."""
    first = sites.groupBy("scaffold").agg(F.min("position").alias("_first"))
    return sites.join(first, "scaffold").withColumn("block", F.floor((F.col("position") - F.col("_first")) / width)).drop("_first")
