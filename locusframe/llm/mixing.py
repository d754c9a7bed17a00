"""Mixing sources to target weights by hash-threshold histograms.

Each row gets a hash of its id and text. Tokens are summed by source and the leading
bits of the hash; the bucket in which a source's budget runs out is the boundary, and
only rows of that bucket are summed again by the next bits. After the last level the
threshold is one hash prefix per source, and rows are filtered by a comparison: no
sort, and a larger budget keeps everything a smaller one kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import WORD, checkpoint

BITS, LEVELS = 12, 4
#: Rows of the source table up to which it is broadcast.
MAX_BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn. They share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and
    the excess is shared again by weight. In order of ``cap / weight`` the capped
    sources come first, so that one running sum finds where capping ends. The
    windows run over one row per source, not over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.lit(float(weights[-1]))
    for i, w in reversed(list(enumerate(weights[:-1]))):
        pick = F.when(F.pmod(F.col("_rank") - 1, F.lit(len(weights))) == i, F.lit(float(w))).otherwise(pick)
    s = s.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("_all", F.sum("_w").over(everything))
    s = s.withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_all") - F.col("_used")))
    # the first source that its share does not fill sets the level for all after it
    free = F.col("_level") * F.col("_w") <= F.col("_cap")
    first = F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_rank").alias("b"), F.col("_level").alias("level"))
    s = s.withColumn("_final", F.min(F.when(free, first)).over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words, null text 0) and the row's hash."""
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("_hash"),
    )


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    Every row is taken ``floor(target / source_size)`` times, and once more if its
    hash lies below the source's threshold. Rows with equal id and text have equal
    hashes; where such a group is cut, as many of its rows are taken as bring the sum
    nearest to the target, in order of their places, so that reruns give the same rows.
    Sources without words get target 0. A null source is a source; an empty table gives
    an empty mix; further columns are not read. A source's taken words differ from its
    target by half a row, unless different rows share a hash's first 48 bits.
    """
    rows = checkpoint(measure(docs).withColumn("_row", F.monotonically_increasing_id()))
    goal = targets(rows.select("source", "size"), weights, share, float(most))
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    goal = checkpoint(goal)
    few = goal.count() <= MAX_BROADCAST_SOURCES
    small = lambda g: F.broadcast(g) if few else g
    at = lambda level: F.shiftrightunsigned("_hash", 64 - BITS * level)
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    for level in range(1, LEVELS + 1):
        g = goal.select("source", "prefix", "left")
        inside = rows.alias("r").join(small(g).alias("g"), same & ((at(level - 1) == F.col("g.prefix")) if level > 1 else F.lit(True)))
        hist = inside.select("r.source", at(level).alias("b"), "r.size").groupBy("source", "b").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("b")
        hist = hist.withColumn("_before", F.sum("n").over(upto) - F.col("n"))
        hit = hist.alias("h").join(small(g).alias("g"), F.col("h.source").eqNullSafe(F.col("g.source")))
        hit = hit.where("h._before <= g.left").groupBy(F.col("h.source").alias("source")).agg(F.max(F.struct("h.b", "h._before")).alias("x"))
        last = F.shiftleft(F.col("g.prefix"), BITS)
        goal = checkpoint(
            goal.alias("g").join(small(hit).alias("x"), F.col("g.source").eqNullSafe(F.col("x.source")), "left").select(
                "g.source", "g.source_size", "g.target", "g.copies",
                (F.col("g.left") - F.coalesce("x.x._before", F.lit(0))).alias("left"),
                F.coalesce("x.x.b", last).alias("prefix"),
            )
        )
    g = goal
    # of the rows that share the last prefix, as a rule one or equal ones, some go in
    inside = rows.alias("r").join(small(goal.select("source", "prefix", "left")).alias("g"), same & (at(LEVELS) == F.col("g.prefix")))
    inside = checkpoint(inside.select("r.source", "r._row", "r.size", "g.left"))
    edge = inside.groupBy("source", "left").agg(F.count("*").alias("n"), F.sum("size").alias("edge"), F.max("_row").alias("last"))
    wanted = F.round(F.col("left") * F.col("n") / F.greatest(F.col("edge"), F.lit(1))).cast("long")
    edge = checkpoint(edge.select("source", "n", "last", F.least(F.col("n"), F.greatest(wanted, F.lit(0))).alias("wanted")))
    some = edge.where("wanted > 0 and wanted < n").select("source", "wanted")
    last = edge.select("source", F.when(F.col("wanted") > 0, F.col("last")).alias("upto"))
    if not some.isEmpty():
        # the place of the last row that goes in: counted by partition first, then inside one
        part = F.shiftrightunsigned("_row", 33)
        counted = inside.groupBy("source", part.alias("p")).agg(F.count("*").alias("c"))
        counted = counted.withColumn("before", F.sum("c").over(Window.partitionBy("source").orderBy("p")) - F.col("c")).alias("c")
        hit = counted.join(small(some).alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).where("before < wanted and before + c >= wanted")
        hit = hit.select("c.source", "c.p", (F.col("wanted") - F.col("before")).alias("nth")).alias("h")
        within = inside.alias("i").join(small(hit), F.col("i.source").eqNullSafe(F.col("h.source")) & (F.shiftrightunsigned("i._row", 33) == F.col("h.p")))
        within = within.select("i.source", "i._row", "nth", F.row_number().over(Window.partitionBy("i.source", "h.p").orderBy("i._row")).alias("k")).where("k = nth")
        within = checkpoint(within.select("source", F.col("_row").alias("cut")))
        last = last.alias("l").join(small(within).alias("w"), F.col("l.source").eqNullSafe(F.col("w.source")), "left").select("l.source", F.coalesce("w.cut", "l.upto").alias("upto"))
    g = goal.alias("g").join(small(last).alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
    g = checkpoint(g.select("g.*", F.coalesce("e.upto", F.lit(-1)).alias("upto")))
    more = F.when((at(LEVELS) < F.col("g.prefix")) | ((at(LEVELS) == F.col("g.prefix")) & (F.col("r._row") <= F.col("g.upto"))), 1).otherwise(0)
    return rows.alias("r").join(small(g).alias("g"), same).select(
        "r.doc_id", "r.source", "r.size", F.col("g.source_size").cast("long").alias("source_size"), "g.target",
        (F.col("r.size") * F.least(F.lit(most), F.col("g.copies") + more)).cast("long").alias("taken"),
    )
