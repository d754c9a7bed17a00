"""Formatters that turn tables into lines of text formats, and a writer for them.

A formatter gives (ord, line); ``write_lines`` sorts by ord and writes text. Formats that
put a sample's whole genome into one line (PED, PHYLIP, FASTA) gather that line in one
task, as the format demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import bases as B
from locusframe.operators.sites import SITE, letter, n_alleles, ranked_alleles, site_counts


def write_lines(lines: DataFrame, path: str, header: str | None = None, compression: str | None = None) -> None:
    """Writes (ord, line) in order; the header is the first line of the first file."""
    x = lines.orderBy("ord").select("line")
    if header is not None:
        x = lines.sparkSession.createDataFrame([(header,)], "line string").unionByName(x)
    w = x.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


def write_table(rows: DataFrame, path: str, order: list[str], sep: str = ",", compression: str | None = None, places: int | None = 4) -> None:
    """Rows in order as separated text with a header, doubles rounded half to even."""
    if places is not None:
        rows = rows.select(*[F.bround(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
    w = rows.orderBy(*order).write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "nan")
    (w.option("compression", compression) if compression else w).csv(path)


def _cells(calls: DataFrame, render) -> DataFrame:
    g = calls.groupBy(*SITE, "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("a"))
    return g.select(*SITE, "sample", render(F.col("a")).alias("cell"))


def geno_lines(calls: DataFrame, mode: str = "phased", sep: str = "/") -> DataFrame:
    """Lines of a genotype table, samples in order: phased, alleles, diplo, count, random."""
    if mode == "count":
        minor = site_counts(calls).select(*SITE, F.when(n_alleles() == 2, F.get(ranked_alleles(), F.lit(1))["base"]).alias("_m"))
        x = calls.join(minor, SITE)
        g = x.groupBy(*SITE, "sample", "_m").agg(F.collect_list(F.struct("allele")).alias("a"))
        cells = g.select(*SITE, "sample", F.coalesce(B.as_count(F.transform("a", lambda v: v["allele"]), F.col("_m")), F.lit(0)).cast("string").alias("cell"))
    else:
        two = lambda a: B.diploid_code(letter(F.get(a, F.lit(0))), letter(F.get(a, F.lit(1))))
        render = {"phased": lambda a: B.as_phased(a, sep), "alleles": lambda a: B.as_phased(a, ""), "diplo": two, "random": lambda a: letter(B.random_allele(a, *SITE, "sample"))}[mode]
        cells = _cells(calls, render)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "cell"))), lambda x: x["cell"]), "\t")
    return cells.groupBy(*SITE).agg(line.alias("x")).select(F.struct(*SITE).alias("ord"), F.concat_ws("\t", "scaffold", F.col("position").cast("string"), "x").alias("line"))


def fasta(seqs: DataFrame, wrap: int | None = None, gap: bool = False) -> DataFrame:
    """(ord, line) of (name, seq); N as gap on demand."""
    s: Column = F.translate("seq", "Nn", "--") if gap else F.col("seq")
    if wrap:
        s = F.rtrim(F.regexp_replace(s, f"(.{{{wrap}}})", "$1\n"))
    return seqs.select(F.col("name").alias("ord"), F.concat(F.lit(">"), "name", F.lit("\n"), s).alias("line"))


def phylip(seqs: DataFrame) -> DataFrame:
    """(ord, line) of (name, seq), the first line giving number and length."""
    head = seqs.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("l")).select(F.lit("").alias("ord"), F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" "), F.col("l").cast("string")).alias("line"))
    return head.unionByName(seqs.select(F.col("name").alias("ord"), F.concat_ws(" ", "name", "seq").alias("line")))


def sample_sequences(calls: DataFrame, *by: str) -> DataFrame:
    """(by, name, seq): each haplotype's letters in site order."""
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scaffold", "position", letter(F.col("allele")).alias("b")))), lambda x: x["b"]), "")
    return calls.groupBy(*by, "sample", "hap").agg(seq.alias("seq")).select(*by, F.concat(F.col("sample").cast("string"), F.lit("_"), F.char(F.lit(65) + F.col("hap"))).alias("name"), "seq")


def distance_matrix(pairs: DataFrame, keys: list[str], fmt: str = "raw", places: int = 4) -> DataFrame:
    """Rows of a symmetric matrix per window from (keys, s1, s2, dist) of s1 <= s2."""
    turned = pairs.where("s1 <> s2").select(*keys, F.col("s2").alias("s1"), F.col("s1").alias("s2"), "dist")
    p = pairs.select(*keys, "s1", "s2", "dist").unionByName(turned)
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s2", F.coalesce(F.bround("dist", places).cast("string"), F.lit("nan")).alias("d")))), lambda x: x["d"]), " ")
    r = p.groupBy(*keys, "s1").agg(cells.alias("cells"), F.count("*").alias("n"))
    name = F.col("s1").cast("string")
    line = {"raw": F.col("cells"), "phylip": F.concat_ws(" ", name, "cells"), "nexus": F.concat(F.lit("'"), name, F.lit("' "), "cells")}[fmt]
    return r.select(*keys, "s1", "n", line.alias("line"))


def vcf_lines(calls: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(ord, line) of VCF body lines: REF from (scaffold, position, ref), else the commonest allele."""
    c = site_counts(calls).withColumn("_o", F.transform(ranked_alleles(), lambda x: letter(x["base"])))
    if reference is not None:
        c = c.join(reference, SITE, "left").withColumn("_o", F.when(F.col("ref").isNotNull(), F.concat(F.array("ref"), F.array_remove("_o", F.col("ref")))).otherwise(F.col("_o")))
    g = calls.join(c.select(*SITE, "_o"), SITE).withColumn("i", F.coalesce((F.nullif(F.array_position("_o", letter(F.col("allele"))), F.lit(0)) - 1).cast("string"), F.lit(".")))
    g = g.groupBy(*SITE, "_o", "sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hap", "i"))), lambda x: x["i"]), "/").alias("gt"))
    s = g.groupBy(*SITE, "_o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "gt"))), lambda x: x["gt"]), "\t").alias("gts"))
    alt = F.array_join(F.slice("_o", F.lit(2), F.lit(4)), ",")
    return s.select(F.struct(*SITE).alias("ord"), F.concat_ws("\t", "scaffold", F.col("position").cast("string"), F.lit("."), F.coalesce(F.get("_o", F.lit(0)), F.lit("N")), F.when(alt == "", ".").otherwise(alt), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), "gts").alias("line"))


def eigenstrat(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(geno lines, snp lines) of biallelic sites: copies of the first listed allele, 9 if missing."""
    c = site_counts(calls).where(n_alleles() == 2)
    first = F.array_min(F.transform(ranked_alleles(), lambda x: x["base"]))
    last = F.array_max(F.transform(ranked_alleles(), lambda x: x["base"]))
    c = c.select(*SITE, first.alias("_a"), last.alias("_b"))
    g = calls.join(c, SITE).groupBy(*SITE, "sample").agg(F.when(F.count("allele") < F.count("*"), 9).otherwise(F.count_if(F.col("allele") == F.col("_a"))).cast("string").alias("n"))
    geno = g.groupBy(*SITE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "n"))), lambda x: x["n"]), "").alias("line"))
    snp = c.select(F.struct(*SITE).alias("ord"), F.concat_ws("\t", F.concat_ws("_", "scaffold", F.col("position").cast("string")), "scaffold", F.lit("0.0"), F.col("position").cast("string"), letter(F.col("_a")), letter(F.col("_b"))).alias("line"))
    return geno.select(F.struct(*SITE).alias("ord"), "line"), snp


def plink(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ped lines, map lines): a sample's letters in site order, missing as 0."""
    b = F.when(F.col("allele").isNull(), "0").otherwise(letter(F.col("allele")))
    ped = calls.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scaffold", "position", "hap", b.alias("b")))), lambda x: x["b"]), " ").alias("g"))
    name = F.col("sample").cast("string")
    ped = ped.select(F.col("sample").alias("ord"), F.concat_ws(" ", name, name, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("-9"), "g").alias("line"))
    sites = calls.select(*SITE).distinct()
    pos = F.col("position").cast("string")
    return ped, sites.select(F.struct(*SITE).alias("ord"), F.concat_ws("\t", "scaffold", F.concat_ws("_", "scaffold", pos), F.lit("0"), pos).alias("line"))


def frequency_lines(table: DataFrame) -> DataFrame:
    """Lines of a frequency table, populations in order."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pop", F.coalesce(F.col("value").cast("string"), F.lit("nan")).alias("v")))), lambda x: x["v"]), "\t")
    return table.groupBy(*SITE).agg(cells.alias("x")).select(F.struct(*SITE).alias("ord"), F.concat_ws("\t", "scaffold", F.col("position").cast("string"), "x").alias("line"))

