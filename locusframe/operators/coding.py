"""Coding-site classification and coding-sequence alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import bases as B
from locusframe.operators.sites import letter


def coding_positions(genes: DataFrame) -> DataFrame:
    """scaffold, mrna, strand, codon, place (0..2), position of genes (cds: array of start, end)."""
    p = genes.select("scaffold", "mrna", "strand", F.posexplode(B.cds_positions(F.col("cds"), F.col("strand"), trim=True)).alias("i", "position"))
    return p.select("scaffold", "mrna", "strand", F.floor(F.col("i") / 3).alias("codon"), (F.col("i") % 3).cast("long").alias("place"), F.col("position").cast("long").alias("position"))


def coding_sites(genes: DataFrame, alleles: DataFrame, ignore_conflicts: bool = True) -> DataFrame:
    """Per coding position: codon_position (1..3), syn/non and degeneracy.

    ``alleles`` has scaffold, position, bases (letters seen there, in base order). On the
    minus strand letters are complemented. A position with different results in two
    mRNAs has null for all three if conflicts are ignored; else a row per result.
    """
    p = coding_positions(genes).join(alleles, ["scaffold", "position"], "left")
    plain = F.array_join(F.filter(F.split(F.upper(F.coalesce("bases", F.lit(""))), ""), lambda x: x.isin(*"ACGT")), "")
    p = p.withColumn("b", F.when(F.col("strand") == "-", F.reverse(B.complement(plain))).otherwise(plain))
    c = p.groupBy("scaffold", "mrna", "codon").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "position", "b"))), lambda x: F.struct(x["position"].alias("position"), x["b"].alias("b"))).alias("x"))
    sets = F.transform("x", lambda v: v["b"])
    c = c.withColumn("sets", sets).withColumn("kind", B.syn_non(F.col("sets")))
    each = F.array(*[F.struct(F.col("x")[i]["position"].alias("position"), F.lit(i + 1).alias("codon_position"), F.when(F.length(F.col("sets")[i]) == 2, F.col("kind")).alias("syn_non"), B.degeneracy(F.col("sets"), i).alias("degeneracy")) for i in range(3)])
    r = c.select("scaffold", F.explode(each).alias("r")).select("scaffold", "r.*").distinct()
    if not ignore_conflicts:
        return r
    g = r.groupBy("scaffold", "position").agg(F.count("*").alias("n"), F.first(F.struct("codon_position", "syn_non", "degeneracy")).alias("v"))
    return g.select("scaffold", "position", *[F.when(F.col("n") == 1, F.col(f"v.{k}")).alias(k) for k in ("codon_position", "syn_non", "degeneracy")])


def cds_alignments(genes: DataFrame, calls: DataFrame) -> DataFrame:
    """(mrna, sample, hap, sequence): each haplotype's coding sequence, missing as N."""
    p = coding_positions(genes).select("scaffold", "position", "mrna", "strand", (F.col("codon") * 3 + F.col("place")).alias("i"))
    size = F.size(B.cds_positions(F.col("cds"), F.col("strand"), trim=True))
    n = genes.groupBy("mrna").agg((F.max(size) - 1).cast("long").alias("last"))
    # a site's calls meet the genes as one row
    packed = calls.where("sample is not null and hap is not null").groupBy("scaffold", "position").agg(F.collect_list(F.struct("sample", "hap", "allele")).alias("v"))
    # positions are many more rows than the genes by whose size Spark would broadcast them
    x = p.hint("merge").join(packed, ["scaffold", "position"]).select("mrna", "strand", "i", "v")
    # a gene's calls are in one task, of as many as the session has: they look small where Spark would merge partitions
    x = x.repartition(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mrna").select("mrna", "strand", "i", F.inline("v"))
    base = letter(F.col("allele"))
    x = x.withColumn("b", F.when(F.col("strand") == "-", B.complement(base)).otherwise(base))
    got = x.groupBy("mrna", "sample", "hap").agg(F.map_from_entries(F.collect_list(F.struct("i", "b"))).alias("m"))
    return got.join(n, "mrna").select("mrna", "sample", "hap", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("N"))), "").alias("sequence"))
