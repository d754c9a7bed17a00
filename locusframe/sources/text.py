"""Readers for genotype tables, VCF, sequences, annotation and coordinate maps.

Files are read as lines and parsed by built-in expressions, so reading is split and
pruned like any scan. Only a file's header line is looked at on the driver. Formats
whose records span lines are read by record separator.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(n: int | None = None) -> Column:
    return F.split(F.trim("value"), r"\s+", -1 if n is None else n)


def read_geno(spark: SparkSession, path: str, header: list[str] | None = None, scaf_col: int = 0, pos_col: int = 1, first_sample: int = 2) -> DataFrame:
    """scaffold, position, samples (array of sample, gt) of a genotype table.

    The first line that opens with # (or the first line) names the columns unless
    ``header`` does; other lines that open with # are comments; a column number of -1 means there is none. gz files are read as they are.
    """
    text = _lines(spark, path)
    first = None if header else (text.where(F.startswith("value", F.lit("#"))).first() or text.first())["value"]
    names = header or re.split(r"\s+", first.strip())
    body = text.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).withColumn("f", _fields())
    if header is None and not names[0].startswith("#"):
        body = body.where(F.col("value") != first)
    samples = F.array(*[F.struct(F.lit(s).alias("sample"), F.get("f", F.lit(first_sample + i)).alias("gt")) for i, s in enumerate(names[first_sample:])])
    scaf = F.get("f", F.lit(scaf_col)) if scaf_col >= 0 else F.lit(None).cast("string")
    pos = F.get("f", F.lit(pos_col)).cast("long") if pos_col >= 0 else F.lit(None).cast("long")
    return body.select(scaf.alias("scaffold"), pos.alias("position"), samples.alias("samples"))


def geno_calls(geno: DataFrame, samples: DataFrame | None = None, diploid_codes: bool = False) -> DataFrame:
    """A row per haplotype call: scaffold, position, sample, hap, allele (null if not ACGT).

    ``samples`` (sample, ploidy) forces ploidies: shorter genotypes are filled with null,
    longer ones kept only if homozygous.
    """
    from locusframe.functions import bases as B

    x = geno.select("scaffold", "position", F.explode("samples").alias("s")).select("scaffold", "position", "s.sample", "s.gt")
    letters = B.split_genotype(B.diploid_alleles(F.col("gt")) if diploid_codes else F.col("gt"))
    x = x.withColumn("a", F.transform(letters, lambda b: F.when(b.isin(*"ACGT"), (F.position(b, F.lit("ACGT")) - 1).cast("bigint"))))
    if samples is not None:
        x = x.join(F.broadcast(samples) if samples.limit(1_000_001).count() <= 1_000_000 else samples, "sample")
        none = F.transform(F.sequence(F.lit(1), F.col("ploidy")), lambda i: F.lit(None).cast("bigint"))
        n, same = F.size("a"), F.size(F.array_distinct("a")) == 1
        x = x.withColumn("a", F.when(n <= F.col("ploidy"), F.slice(F.concat("a", none), F.lit(1), F.col("ploidy"))).when(same, F.slice("a", F.lit(1), F.col("ploidy"))).otherwise(none))
    return x.select("scaffold", "position", "sample", F.posexplode("a").alias("hap", "allele"))


def read_pops(spark: SparkSession, path: str, inline: dict[str, list[str]] | None = None) -> DataFrame:
    """(sample, pop), from a two-column file and named lists."""
    p = _lines(spark, path).where(F.trim("value") != "").select(F.get(_fields(), F.lit(0)).alias("sample"), F.get(_fields(), F.lit(1)).alias("pop"))
    if inline:
        p = p.unionByName(spark.createDataFrame([(s, k) for k, v in inline.items() for s in v], "sample string, pop string"))
    return p.distinct()


def read_ploidy(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).where(F.trim("value") != "").select(F.get(_fields(), F.lit(0)).alias("sample"), F.get(_fields(), F.lit(1)).cast("int").alias("ploidy"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """(wname, scaffold, start, end); NA where the file has no name."""
    f = _lines(spark, path).where(F.trim("value") != "").select(_fields().alias("f"))
    return f.select(F.coalesce(F.get("f", F.lit(3)), F.lit("NA")).alias("wname"), F.col("f")[0].alias("scaffold"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"))


def parse_region(region: Column) -> Column:
    """CHR[:from[-to]][:+/-] as a struct; exchanged coordinates turn the strand."""
    rx = r"^([^:]+)(?::(\d+)(?:-(\d+))?)?(?::([+-]))?$"
    g = lambda i: F.nullif(F.regexp_extract(region, rx, i), F.lit(""))
    a, b, strand = g(2).cast("long"), g(3).cast("long"), F.coalesce(g(4), F.lit("+"))
    turned = F.coalesce(b < a, F.lit(False))
    return F.struct(
        g(1).alias("chrom"), F.when(turned, b).otherwise(a).alias("start"), F.when(turned, a).otherwise(b).alias("end"),
        F.when(turned, F.when(strand == "+", "-").otherwise("+")).otherwise(strand).alias("strand"),
    )


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(scaffold, length) of a sequence index."""
    return _lines(spark, path).where(F.trim("value") != "").select(F.get(_fields(), F.lit(0)).alias("scaffold"), F.get(_fields(), F.lit(1)).cast("long").alias("length"))


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    """Pieces new_scaf, new_start, new_end, scaf, start, end, strand of a 9- or 7-column map."""
    f = _lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(_fields().alias("f"))
    f = f.where(~((F.size("f") >= 9) & F.get("f", F.lit(4)).isin("N", "U")))
    at = F.when(F.size("f") >= 9, 5).otherwise(3)
    g = lambda i: F.get("f", at + i)
    return f.select(
        F.col("f")[0].alias("new_scaf"), F.col("f")[1].cast("long").alias("new_start"), F.col("f")[2].cast("long").alias("new_end"),
        g(0).alias("scaf"), g(1).cast("long").alias("start"), g(2).cast("long").alias("end"), g(3).alias("strand"),
    )


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(name, seq); the name is the header's first word."""
    r = spark.read.option("lineSep", ">").text(path).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s", "")
    return r.select(F.get(F.split(F.trim(head), r"\s+"), F.lit(0)).alias("name"), (F.upper(seq) if upper else seq).alias("seq"))


def parse_phylip(text: str) -> list[tuple[int, str, str]]:
    """(alignment, name, seq) of one or more alignments, sequential or interleaved."""
    out, lines, i, k = [], [x.strip() for x in text.split("\n")], 0, 0
    while i < len(lines):
        head = lines[i].split()
        i += 1
        if len(head) != 2 or not all(x.isdigit() for x in head):
            continue
        n, length = map(int, head)
        names: list[str] = []
        seqs: list[str] = []
        while i < len(lines) and len(names) < n:
            if f := lines[i].split():
                names.append(f[0])
                seqs.append("".join(f[1:]))
            i += 1
        j = 0
        while i < len(lines) and any(len(s) < length for s in seqs):
            if lines[i]:
                seqs[j % n] += "".join(lines[i].split())
                j += 1
            i += 1
        out += [(k, a, s) for a, s in zip(names, seqs, strict=True)]
        k += 1
    return out


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """(alignment, name, seq); alignments of a file are read together."""

    def parse(batches):
        import pandas as pd

        for b in batches:
            for t in b["value"]:
                yield pd.DataFrame(parse_phylip(t), columns=["alignment", "name", "seq"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "alignment long, name string, seq string")


def read_genes(spark: SparkSession, path: str, fmt: str = "gff") -> DataFrame:
    """(scaffold, mrna, start, end, strand, cds) of GFF3 or GTF annotation."""
    f = _lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f")).where("size(f) >= 9")
    f = f.select(F.col("f")[0].alias("scaffold"), F.col("f")[2].alias("kind"), F.col("f")[3].cast("long").alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[6].alias("strand"), F.col("f")[8].alias("attr"))
    if fmt == "gff":
        key = lambda k: F.nullif(F.regexp_extract("attr", rf"(?:^|;)\s*{k}=([^;]+)", 1), F.lit(""))
        own, parent = key("ID"), key("Parent")
    else:
        own = parent = F.nullif(F.regexp_extract("attr", r'transcript_id "([^"]+)"', 1), F.lit(""))
    m = f.where(F.col("kind").isin("mRNA", "transcript")).select("scaffold", own.alias("mrna"), "start", "end", "strand")
    c = f.where("kind = 'CDS'").select(F.explode(F.split(parent, ",")).alias("mrna"), F.struct("start", "end").alias("x"))
    return m.join(c.groupBy("mrna").agg(F.array_sort(F.collect_list("x")).alias("cds")), "mrna").select("scaffold", "mrna", "start", "end", "strand", "cds")


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(block, source, start, size, strand, src_size, seq) of multiple alignment blocks."""
    r = spark.read.option("lineSep", "\na").text(path)
    b = r.withColumn("block", F.xxhash64("value")).select("block", F.explode(F.split("value", "\n")).alias("l")).where("l like 's %' or l like 's\t%'")
    f = F.split(F.trim("l"), r"\s+")
    return b.select("block", f[1].alias("source"), f[2].cast("long").alias("start"), f[3].cast("long").alias("size"), f[4].alias("strand"), f[5].cast("long").alias("src_size"), f[6].alias("seq"))


def vcf_header(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, int | None]]]:
    """Sample names, and contigs with their lengths."""
    lines = [r["value"] for r in _lines(spark, path).where(F.startswith("value", F.lit("##contig")) | F.startswith("value", F.lit("#CHROM"))).collect()]
    contigs = []
    for x in lines:
        if m := re.match(r"##contig=<ID=([^,>]+)(?:.*?length=(\d+))?", x):
            contigs.append((m[1], int(m[2]) if m[2] else None))
    head = next(x for x in lines if x.startswith("#CHROM"))
    return head.split("\t")[9:], contigs


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info (map), calls (array of sample, fields map)."""
    samples, _ = vcf_header(spark, path)
    f = _lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    c = lambda i: F.get("f", F.lit(i))
    keys = F.split(F.coalesce(c(8), F.lit("")), ":")

    def fields(cell: Column) -> Column:
        v = F.split(F.coalesce(cell, F.lit(".")), ":")
        padded = F.slice(F.concat(v, F.transform(keys, lambda k: F.lit("."))), F.lit(1), F.size(keys))
        return F.map_from_arrays(keys, padded)

    calls = F.array(*[F.struct(F.lit(s).alias("sample"), fields(c(9 + i)).alias("fields")) for i, s in enumerate(samples)])
    alt = F.filter(F.split(c(4), ","), lambda x: x != ".")
    return f.select(
        c(0).alias("chrom"), c(1).cast("long").alias("pos"), c(2).alias("id"), c(3).alias("ref"), alt.alias("alt"), F.expr("try_cast(get(f, 5) as double)").alias("qual"),
        c(6).alias("filter"), F.str_to_map(c(7), F.lit(";"), F.lit("=")).alias("info"), calls.alias("calls"),
    )


# ---- VCF semantics


def site_type() -> Column:
    """MONO, SNP or INDEL of ref and alt."""
    longest = F.array_max(F.transform(F.concat(F.array("ref"), "alt"), lambda x: F.length(x)))
    return F.when(F.size("alt") == 0, "MONO").when(longest > 1, "INDEL").otherwise("SNP")


def call_type(gt: Column) -> Column:
    """Missing, HomRef, HomAlt or Het of a GT field."""
    a = F.split(gt, r"[/|]")
    return F.when(F.exists(a, lambda x: x == "."), "Missing").when(F.size(F.array_distinct(a)) > 1, "Het").when(a[0] == "0", "HomRef").otherwise("HomAlt")


def filter_vcf(vcf: DataFrame, min_qual: float | None = None, max_ref: int | None = None) -> DataFrame:
    """Rows of low numeric quality or with a long REF are dropped; no quality passes."""
    if min_qual is not None:
        vcf = vcf.where(F.col("qual").isNull() | (F.col("qual") >= min_qual))
    return vcf if max_ref is None else vcf.where(F.length("ref") <= max_ref)


def vcf_calls(vcf: DataFrame, gt_filters: list[dict] = (), skip_indels: bool = False, keep_partial: bool = False, ploidy: int | None = None, mismatch: str = "raise") -> DataFrame:
    """A row per site and sample: scaffold, position, sample, gt (letters), phase.

    A filter has flag, min, max and optionally site_types, gt_types, samples; where it
    applies, all of the flag's comma-separated values must be numbers within the bounds,
    else the genotype becomes missing. With ``skip_indels`` alleles whose length is not
    the reference's are missing; unless ``keep_partial``, one missing allele makes all so.
    Where ``ploidy`` is given, a genotype of another number of alleles ends the job with an
    error, or becomes ``ploidy`` missing alleles if ``mismatch`` is "missing".
    """
    x = vcf.select(F.col("chrom").alias("scaffold"), F.col("pos").alias("position"), "ref", "alt", site_type().alias("site_type"), F.explode("calls").alias("c"))
    x = x.select("*", F.col("c.sample").alias("sample"), F.col("c.fields").alias("v")).withColumn("code", F.coalesce(F.try_element_at("v", F.lit("GT")), F.lit("./.")))
    ok = F.lit(True)
    for f in gt_filters:
        use = F.lit(True)
        if f.get("site_types"):
            use &= F.col("site_type").isin(*f["site_types"])
        if f.get("gt_types"):
            use &= call_type(F.col("code")).isin(*f["gt_types"])
        if f.get("samples"):
            use &= F.col("sample").isin(*f["samples"])
        numbers = F.transform(F.split(F.coalesce(F.try_element_at("v", F.lit(f["flag"])), F.lit(".")), ","), lambda s: s.try_cast("double"))
        inside = F.forall(numbers, lambda n: F.coalesce((n >= f.get("min", float("-inf"))) & (n <= f.get("max", float("inf"))), F.lit(False)))
        ok &= ~use | inside
    alleles = F.concat(F.array("ref"), "alt")
    if skip_indels:
        alleles = F.transform(alleles, lambda a: F.when(F.length(a) == F.length("ref"), a))
    got = F.transform(F.split("code", r"[/|]"), lambda i: F.coalesce(F.get(alleles, i.try_cast("int")), F.lit("N")))
    got = F.when(ok, got).otherwise(F.transform(got, lambda a: F.lit("N")))
    if not keep_partial:
        got = F.when(F.exists(got, lambda a: a == "N"), F.transform(got, lambda a: F.lit("N"))).otherwise(got)
    if ploidy is not None:
        other = F.size(F.split("code", r"[/|]")) != ploidy
        if mismatch == "missing":
            got = F.when(other, F.array_repeat(F.lit("N"), ploidy)).otherwise(got)
        else:
            says = F.concat_ws(" ", F.col("sample"), F.col("scaffold"), F.col("position").cast("string"), F.col("code"), F.lit(f"is not of ploidy {ploidy}"))
            got = F.when(other, F.raise_error(says).cast("array<string>")).otherwise(got)
    phase = F.when(F.contains("code", F.lit("|")), "|").otherwise("/")
    return x.select("scaffold", "position", "sample", F.array_join(got, "|").alias("_p"), phase.alias("phase")).select("scaffold", "position", "sample", F.when(F.col("phase") == "|", F.col("_p")).otherwise(F.replace("_p", F.lit("|"), F.lit("/"))).alias("gt"), "phase")


def vcf_field(vcf: DataFrame, flag: str, missing: str = ".") -> DataFrame:
    """scaffold, position, sample, value of any FORMAT field."""
    x = vcf.select(F.col("chrom").alias("scaffold"), F.col("pos").alias("position"), F.explode("calls").alias("c"))
    return x.select("scaffold", "position", "c.sample", F.coalesce(F.try_element_at("c.fields", F.lit(flag)), F.lit(missing)).alias("value"))


def expand_multi(rows: DataFrame) -> DataFrame:
    """Multi-base references as a row per base: position, ref and each alt's letter there."""
    x = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("ref") - 1)))
    at = lambda s: F.substring(s, F.col("i") + 1, F.lit(1))
    return x.withColumn("pos", F.col("pos") + F.col("i")).withColumn("alt", F.transform("alt", lambda a: F.when(F.length(a) > F.col("i"), at(a)).otherwise("N"))).withColumn("ref", at(F.col("ref"))).drop("i")


def simplify_alt(alt: Column, cigar: Column) -> Column:
    """An alternative allele laid out on the reference's bases by its CIGAR.

    Matches and mismatches copy, deletions give gaps, insertions are left out.
    """
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MXDI=])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, r"\d+", 0).cast("int").alias("n"), F.right(o, F.lit(1)).alias("op")))
    out = F.aggregate(
        ops, F.struct(F.lit(1).alias("at"), F.lit("").alias("s")),
        lambda a, o: F.struct(
            (a["at"] + F.when(o["op"] == "D", 0).otherwise(o["n"])).alias("at"),
            F.concat(a["s"], F.when(o["op"] == "D", F.repeat(F.lit("-"), o["n"])).when(o["op"] == "I", F.lit("")).otherwise(F.substring(alt, a["at"], o["n"]))).alias("s"),
        ), lambda a: a["s"],
    )
    return out


def maf_calls(maf: DataFrame, ref: str, min_size: int = 0, min_seqs: int = 1) -> DataFrame:
    """scaffold, position, source, base of the reference's columns in alignment blocks.

    Sources are "genome.scaffold"; blocks without the reference, shorter than ``min_size``
    or with fewer sequences are left out; on the minus strand positions run backwards
    and bases are complemented.
    """
    from locusframe.functions import bases as B

    b = maf.withColumn("genome", F.substring_index("source", ".", 1)).withColumn("scaf", F.expr("substring(source, instr(source, '.') + 1)"))
    r = b.where((F.col("genome") == ref) & (F.col("size") >= min_size)).select("block", F.col("scaf").alias("scaffold"), F.col("start").alias("r0"), F.col("strand").alias("rs"), F.col("src_size").alias("rn"), F.col("seq").alias("rseq"))
    n = b.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") >= min_seqs)
    x = b.join(r, "block").join(n, "block").select("*", F.posexplode(F.filter(F.split("rseq", ""), lambda c: c != "")).alias("i", "rb")).where("rb <> '-'")
    before = F.length(F.replace(F.substring(F.col("rseq"), F.lit(1), F.col("i")), F.lit("-"), F.lit("")))
    pos = F.when(F.col("rs") == "-", F.col("rn") - F.col("r0") - before).otherwise(F.col("r0") + before + 1)
    base = F.upper(F.substring(F.col("seq"), F.col("i") + 1, F.lit(1)))
    return x.select("scaffold", pos.cast("long").alias("position"), F.col("genome").alias("sample"), F.when(F.col("rs") == "-", B.complement(base)).otherwise(base).alias("base"))
