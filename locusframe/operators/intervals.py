"""Interval joins, interval reduction, liftover and sequence assembly.

Range joins are equi-joins on (chromosome, bin): an interval is listed once per bin it
touches and pairs are kept in one bin only, so both sides hash-partition and no
nested loop is planned, whatever their sizes. Ends are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 10_000


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, chrom: str = "scaffold", at: str = "position", size: int = BIN, how: str = "inner") -> DataFrame:
    """Points joined with the intervals (chrom, start, end, ...) that contain them."""
    p = points.withColumn("_bin", F.floor(F.col(at) / size))
    i = intervals.withColumnRenamed(chrom, "_chrom").withColumn("_ibin", _bins(F.col("start"), F.col("end"), size))
    on = (F.col(chrom) == F.col("_chrom")) & (F.col("_bin") == F.col("_ibin")) & F.col(at).between(F.col("start"), F.col("end"))
    out = p.join(i, on, how)
    return out.drop("_bin", "_ibin", "_chrom") if how not in ("left_semi", "left_anti") else out.drop("_bin")


def pairs_of_intervals(a: DataFrame, b: DataFrame, how: str = "overlap", size: int = BIN) -> DataFrame:
    """(a_id, b_id) of intervals (id, chrom, start, end): a overlaps or contains b."""
    x = a.select(F.col("id").alias("a_id"), "chrom", F.col("start").alias("s1"), F.col("end").alias("e1")).withColumn("bin", _bins(F.col("s1"), F.col("e1"), size))
    y = b.select(F.col("id").alias("b_id"), "chrom", F.col("start").alias("s2"), F.col("end").alias("e2")).withColumn("bin", _bins(F.col("s2"), F.col("e2"), size))
    hit = {"overlap": "s1 <= e2 and s2 <= e1", "contain": "s1 <= s2 and e2 <= e1"}[how]
    # of the bins both touch, the first one reports
    return x.join(y, ["chrom", "bin"]).where(hit).where(F.col("bin") == F.floor(F.greatest("s1", "s2") / size)).select("a_id", "b_id")


def reduce_intervals(intervals: DataFrame, size: int = BIN) -> DataFrame:
    """Maximal unions of intervals that share a position, per chromosome.

    Sorted and scanned by (chromosome, bin of the start); how far earlier bins reach and
    how many unions they open comes from a row per bin, so no task has a whole
    chromosome's intervals.
    """
    x = intervals.select("chrom", "start", "end").withColumn("_bin", F.floor(F.col("start") / size))
    bins = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("chrom", "_bin").orderBy("start", "end")
    reach = x.groupBy("chrom", "_bin").agg(F.max("end").alias("_m")).withColumn("_reach", F.max("_m").over(bins)).drop("_m")
    x = x.join(reach, ["chrom", "_bin"])
    before = F.greatest("_reach", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    opened = x.groupBy("chrom", "_bin").agg(F.sum("_new").alias("_n")).withColumn("_open", F.coalesce(F.sum("_n").over(bins), F.lit(0))).drop("_n")
    here = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_here", here).join(opened, ["chrom", "_bin"]).withColumn("_island", F.col("_open") + F.col("_here"))
    return x.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def liftover(rows: DataFrame, transfers: DataFrame, size: int = BIN) -> DataFrame:
    """Coordinates (id, scaf, start, end, maybe strand) on new scaffolds.

    ``transfers`` maps [start, end] of scaf to [new_start, new_end] of new_scaf with a
    strand. Rows whose ends do not lie in exactly one and the same piece are BROKEN, of
    an unknown scaffold MISSING; a minus strand exchanges the ends and turns the row's
    own strand. Rows are judged one by one: ids may repeat or be null.
    """
    t = transfers.select("new_scaf", "new_start", "new_end", F.col("scaf").alias("t_scaf"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("strand").alias("t_strand"))
    binned = t.withColumn("bin", _bins(F.col("t_start"), F.col("t_end"), size))
    spans = rows.select("scaf", "start", "end").distinct()
    ends = spans.select("*", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("side")).withColumn("p", F.when(F.col("side") == "start", F.col("start")).otherwise(F.col("end")))
    ends = ends.withColumn("_bin", F.floor(F.col("p") / size))
    hit = (F.col("scaf") == F.col("t_scaf")) & (F.col("_bin") == F.col("bin")) & F.col("p").between(F.col("t_start"), F.col("t_end"))
    new = F.when(F.col("t_strand") == "-", F.col("new_end") - (F.col("p") - F.col("t_start"))).otherwise(F.col("new_start") + (F.col("p") - F.col("t_start")))
    piece = F.struct("new_scaf", "new_start", "t_strand")
    of = lambda side, c: F.when(F.col("side") == side, c)
    moved = ends.join(binned, hit).groupBy("scaf", "start", "end").agg(
        F.count(of("start", F.lit(1))).alias("n_start"), F.count(of("end", F.lit(1))).alias("n_end"), F.min(of("start", piece)).alias("piece"), F.min(of("end", piece)).alias("piece_end"),
        F.min(of("start", new)).alias("p_start"), F.min(of("end", new)).alias("p_end"),
    )
    known = t.select(F.col("t_scaf").alias("scaf"), F.lit(True).alias("known")).distinct()
    x = rows.join(moved, ["scaf", "start", "end"], "left").join(known, "scaf", "left")
    ok = F.coalesce((F.col("n_start") == 1) & (F.col("n_end") == 1) & (F.col("piece") == F.col("piece_end")), F.lit(False))
    turned = F.col("piece.t_strand")
    strand = turned if "strand" not in rows.columns else F.when(turned == "-", F.translate("strand", "+-", "-+")).otherwise(F.col("strand"))
    return x.select(
        "id", "scaf", "start", "end",
        F.when(ok, F.col("piece.new_scaf")).alias("new_scaf"),
        F.when(ok, F.least("p_start", "p_end")).alias("new_start"),
        F.when(ok, F.greatest("p_start", "p_end")).alias("new_end"),
        F.when(ok, strand).alias("strand"),
        F.when(ok, "OK").when(F.col("known").isNull(), "MISSING").otherwise("BROKEN").alias("status"),
    )


def assemble(pieces: DataFrame, sequences: DataFrame) -> DataFrame:
    """(new_scaf, sequence): pieces in place, minus strands reversed, gaps filled with N."""
    from locusframe.functions.bases import reverse_complement

    s = pieces.join(sequences.select(F.col("name").alias("scaf"), "seq"), "scaf")
    part = F.substring(F.col("seq"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    s = s.withColumn("part", F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part))
    s = s.withColumn("_last", F.lag("new_end", 1, 0).over(Window.partitionBy("new_scaf").orderBy("new_start")))
    s = s.withColumn("part", F.concat(F.repeat(F.lit("N"), F.greatest(F.lit(0), F.col("new_start") - F.col("_last") - 1).cast("int")), "part"))
    return s.groupBy("new_scaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_start", "part"))), lambda x: x["part"]), "").alias("sequence"))
