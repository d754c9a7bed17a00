"""Headers, side files and whole-file texts that go with the line formatters.

Headers and per-sample files are small by their nature (a line per sample or contig);
texts of matrices are a value per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.sites import SITE, letter


def vcf_header(samples: list, contigs: list[tuple[str, int]] = ()) -> str:
    """The header of a VCF of genotypes only; contigs are (name, length)."""
    lines = ["##fileformat=VCFv4.2", *(f"##contig=<ID={n},length={size}>" for n, size in contigs), '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, samples)])])


def eigenstrat_individuals(samples: DataFrame) -> DataFrame:
    """(ord, line) of the file of individuals: sample, unknown sex, no population."""
    return samples.select(F.col("sample").alias("ord"), F.concat(F.col("sample").cast("string"), F.lit("  U  NA")).alias("line")).distinct()


def plink_family(samples: DataFrame) -> DataFrame:
    """(ord, line) of the family file."""
    return samples.select(F.col("sample").alias("ord"), F.concat(F.lit("0 "), F.col("sample").cast("string"), F.lit(" 0 0 0 0")).alias("line")).distinct()


def cumulative_positions(sites: DataFrame) -> DataFrame:
    """``sites`` with ``cumulative``: the position after the last ones of all scaffolds before, in name order."""
    last = sites.groupBy("scaffold").agg(F.max("position").alias("_last"))  # a row per scaffold
    before = Window.orderBy("scaffold").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.coalesce(F.sum("_last").over(before), F.lit(0))).drop("_last")
    return sites.join(last, "scaffold").withColumn("cumulative", F.col("position") + F.col("_before")).drop("_before")


def matrix_text(rows: DataFrame, keys: list[str], fmt: str = "raw") -> DataFrame:
    """(keys, text): a window's matrix as one text from (keys, s1, cells).

    ``raw`` has the rows alone, ``phylip`` the number of names first, ``nexus`` a block of
    taxa and one of distances. A matrix grows with the samples only.
    """
    x = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s1", "cells"))).alias("x")) if keys else rows.agg(F.array_sort(F.collect_list(F.struct("s1", "cells"))).alias("x"))
    n, name = F.size("x").cast("string"), lambda v: v["s1"].cast("string")
    each = lambda f: F.array_join(F.transform("x", f), "\n")
    number = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] '"))
    text = {
        "raw": each(lambda v: v["cells"]),
        "phylip": F.concat_ws("\n", n, each(lambda v: F.concat(name(v), F.lit("  "), v["cells"]))),
        "nexus": F.concat(
            F.lit("\nBEGIN Taxa;\nDIMENSIONS ntax="), n, F.lit(";\nTAXLABELS\n"), each(lambda v, i: F.concat(number(i), name(v), F.lit("'"))), F.lit("\n;\nEND; [Taxa]\n"),
            F.lit("\nBEGIN Distances;\nDIMENSIONS ntax="), n, F.lit(";\nFORMAT labels=left diagonal triangle=both;\nMATRIX\n"),
            each(lambda v, i: F.concat(number(i), name(v), F.lit("'    "), v["cells"])), F.lit("\n;\nEND; [Distances]\n"),
        ),
    }[fmt]
    return x.select(*keys, text.alias("text"))


def write_by(rows: DataFrame, path: str, *keys: str) -> None:
    """Lines (keys, ord, line) as a folder of text per value of the keys, in order within each."""
    rows.repartition(*keys).sortWithinPartitions(*keys, "ord").select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path)


def tree_lines(trees: DataFrame) -> DataFrame:
    """(replicate, ord, line): a tree a line in the order of windows, NA where there is none; for ``write_by`` replicate."""
    return trees.select("replicate", F.struct("scaffold", "start").alias("ord"), F.coalesce("newick", F.lit("NA")).alias("line"))


def tree_data_lines(trees: DataFrame) -> DataFrame:
    """(ord, line): the windows of the trees, tab-separated, in the order in which ``tree_lines`` has them."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("scaffold", "start", "end", "mid", "sites")]
    return trees.where("replicate = 0").select(F.struct("scaffold", "start").alias("ord"), F.concat_ws("\t", *cells).alias("line"))


def spectrum_lines(spectrum: DataFrame, dims: list[int]) -> DataFrame:
    """(ord, line) of a spectrum: the counts per population and the number of sites, tab-separated."""
    cols = [F.col(f"n_{d}") for d in dims]
    return spectrum.select(F.struct(*cols).alias("ord"), F.concat_ws("\t", *[c.cast("string") for c in cols], F.col("sites").cast("string")).alias("line"))


def ordered_letters(calls: DataFrame, sep: str = "/") -> DataFrame:
    """scaffold, position, sample, gt: a genotype's letters, the site's commoner alleles first (lower base on ties)."""
    n = calls.where("allele is not null").groupBy(*SITE, "allele").agg(F.count("*").alias("_n"))
    g = calls.join(n, [*SITE, "allele"], "left")
    cell = F.array_sort(F.collect_list(F.struct((-F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("allele", F.lit(9)).alias("a"), letter(F.col("allele")).alias("b"))))
    return g.groupBy(*SITE, "sample").agg(F.array_join(F.transform(cell, lambda v: v["b"]), sep).alias("gt"))
