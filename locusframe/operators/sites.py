"""Per-site aggregates and the site filters built on them.

``calls`` has a row per haplotype: scaffold, position, sample, pop, hap, allele (0..3,
null if missing). Everything here is one hash aggregation by site (or site and
population), combined on the map side, and column expressions over its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = ["scaffold", "position"]
BASES = "ACGT"
COUNTS = ["n_a", "n_c", "n_g", "n_t"]


def site_counts(calls: DataFrame, *by: str, **more: Column) -> DataFrame:
    """Base counts, called haplotypes and all haplotypes per site (and ``by``); ``more`` are further aggregates."""
    counts = [F.count_if(F.col("allele") == i).alias(c) for i, c in enumerate(COUNTS)]
    return calls.groupBy(*SITE, *by).agg(*counts, F.count("allele").alias("called"), F.count("*").alias("haps"), *[x.alias(n) for n, x in more.items()])


def counts_array() -> Column:
    return F.array(*COUNTS)


def n_alleles(counts: Column | None = None) -> Column:
    return F.size(F.filter(counts_array() if counts is None else counts, lambda x: x > 0)).cast("long")


def ranked_alleles() -> Column:
    """Alleles present as (count, base), most frequent first, ties by lower base."""
    both = F.transform(counts_array(), lambda n, i: F.struct((-n).alias("neg"), i.cast("long").alias("base")))
    return F.filter(F.array_sort(both), lambda x: x["neg"] < 0)


def second_count() -> Column:
    """The second largest of the four counts."""
    return F.element_at(F.sort_array(counts_array(), asc=False), 2)


def site_pi() -> Column:
    """Pairs of called haplotypes that differ, as a share of all pairs; null below two."""
    n = F.col("called")
    same = sum((F.col(c) * (F.col(c) - 1) for c in COUNTS), F.lit(0))
    return F.try_divide((n * (n - 1) - same).cast("double"), (n * (n - 1)).cast("double"))


def base_frequencies(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[F.try_divide(F.col(c).cast("double"), F.col("called").cast("double")).alias(f"f{c[1:]}") for c in COUNTS])


def alleles_text() -> Column:
    """Letters of the alleles present, in base order."""
    return F.concat(*[F.when(F.col(c) > 0, F.lit(b)).otherwise("") for c, b in zip(COUNTS, BASES, strict=True)])


def letter(base: Column) -> Column:
    """0..3 as a letter, null as N."""
    return F.coalesce(F.substring(F.lit(BASES), (base + 1).cast("int"), F.lit(1)), F.lit("N"))


def major_alleles() -> Column:
    """Letters of all bases that reach the largest count; empty without calls."""
    top = F.greatest(*COUNTS)
    return F.concat(*[F.when((F.col(c) == top) & (top > 0), F.lit(b)).otherwise("") for c, b in zip(COUNTS, BASES, strict=True)])


def minor_allele() -> Column:
    """The rarer of two alleles, the lower base on a tie; null unless there are two."""
    by_count = F.array_sort(F.transform(F.filter(ranked_alleles(), lambda x: x["neg"] < 0), lambda x: F.struct((-x["neg"]).alias("n"), x["base"].alias("base"))))
    return F.when(n_alleles() == 2, F.get(by_count, F.lit(0))["base"])


def genotypes(calls: DataFrame) -> DataFrame:
    """A row per site and sample: alleles in haplotype order, how many are called."""
    g = calls.groupBy(*SITE, "sample", "pop").agg(
        F.array_sort(F.collect_list(F.struct("hap", "allele"))).alias("x"), F.count("allele").alias("n_called"), F.count("*").alias("ploidy"),
    )
    g = g.withColumn("alleles", F.transform("x", lambda v: v["allele"])).drop("x")
    return g.withColumn("n_distinct", F.size(F.array_distinct(F.array_compact("alleles"))).cast("long"))


def _per_sample(calls: DataFrame, *by: str) -> DataFrame:
    """A row per site, sample (and ``by``): base counts, called and all haplotypes, least and greatest allele."""
    return site_counts(calls, *by, "sample", lo=F.min("allele"), hi=F.max("allele"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in (*COUNTS, "called", "haps")]


def _genotype_counts() -> list[Column]:
    """Genotypes fully called, heterozygous and in all, of rows by ``_per_sample``."""
    full = F.col("called") == F.col("haps")
    het = (F.col("lo") < F.col("hi")) | ((F.col("called") > 0) & ~full)
    return [F.count_if(full).alias("full_calls"), F.count_if(het).alias("het_calls"), F.count("*").alias("n_samples")]


def call_metrics(calls: DataFrame) -> DataFrame:
    """Per site: genotypes fully called, heterozygous and in all.

    A genotype is heterozygous if it has more than one symbol, a missing allele being a
    symbol; the share's denominator takes fully called genotypes only.
    """
    return _per_sample(calls).groupBy(*SITE).agg(*_genotype_counts())


def filter_sites(
    calls: DataFrame, min_calls: int = 1, min_alleles: int = 1, max_alleles: int = 4, min_var_count: int | None = None,
    max_het: float | None = None, min_freq: float | None = None, max_freq: float | None = None,
) -> DataFrame:
    """Sites that pass all population-free filters, with the metrics they were judged by."""
    # one aggregation by site and sample, then by site: no join, and no second pass over the calls
    m = _per_sample(calls.where("scaffold is not null and position is not null")).groupBy(*SITE).agg(*_sums(), *_genotype_counts())
    m = m.withColumn("n_alleles", n_alleles()).withColumn("second", second_count())
    m = m.withColumn("het", F.try_divide(F.col("het_calls").cast("double"), F.col("full_calls").cast("double")))
    m = m.withColumn("second_freq", F.try_divide(F.col("second").cast("double"), F.col("called").cast("double")))
    varied = F.col("n_alleles") > 1
    ok = (F.col("full_calls") >= min_calls) & F.col("n_alleles").between(min_alleles, max_alleles)
    if min_var_count:
        ok &= ~varied | (F.col("second") >= min_var_count)
    if max_het is not None:
        ok &= F.coalesce(F.col("het") <= max_het, F.lit(False))
    if min_freq:
        ok &= ~varied | (F.col("second_freq") >= min_freq)
    if max_freq:
        ok &= ~varied | (F.col("second_freq") <= max_freq)
    return m.where(ok)


def population_filter(
    calls: DataFrame, min_pop_calls: int = 0, fixed: bool = False, min_pop_alleles: int = 0, max_pop_alleles: int = 4, nearly_fixed: float | None = None
) -> DataFrame:
    """Sites that pass the filters over populations."""
    calls = calls.where("scaffold is not null and position is not null and pop is not null")
    per = site_counts(calls, "pop", "sample").groupBy(*SITE, "pop").agg(*_sums(), F.count_if(F.col("called") == F.col("haps")).alias("pop_calls"))
    per = base_frequencies(per).withColumn("k", n_alleles())
    spread = F.greatest(*[F.max(f"f{c[1:]}") - F.min(f"f{c[1:]}") for c in COUNTS])
    s = per.groupBy(*SITE).agg(
        F.min("pop_calls").alias("min_calls"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), spread.alias("spread"),
        *[F.sum(c).alias(c) for c in COUNTS],
    ).withColumn("n_alleles", n_alleles())
    ok = (F.col("min_calls") >= min_pop_calls) & (F.col("min_k") >= min_pop_alleles) & (F.col("max_k") <= max_pop_alleles)
    if fixed:
        ok &= (F.col("min_k") == 1) & (F.col("max_k") == 1) & (F.col("n_alleles") > 1)
    if nearly_fixed is not None:
        ok &= F.coalesce(F.col("spread") >= nearly_fixed, F.lit(False))
    return s.where(ok)


def derived_allele(counts: DataFrame, outgroup, one_derived: bool = True) -> DataFrame:
    """Per site the ingroup allele that a monomorphic outgroup lacks.

    The ingroup must hold the outgroup's allele and one other (or more, of which the
    most frequent counts, if ``one_derived`` is false).
    """
    out = F.col("pop") == F.lit(outgroup)
    both = counts.groupBy(*SITE).agg(
        *[F.sum(F.when(out, F.col(c)).otherwise(0)).alias(f"o{c}") for c in COUNTS], *[F.sum(F.when(~out, F.col(c)).otherwise(0)).alias(c) for c in COUNTS]
    )
    outs = F.array(*[f"o{c}" for c in COUNTS])
    anc = F.array_position(F.transform(outs, lambda x: x > 0), True) - 1
    derived = F.filter(ranked_alleles(), lambda x: x["base"] != F.col("ancestral"))
    k = n_alleles()
    has = F.get(counts_array(), F.col("ancestral").cast("int")) > 0
    ok = (n_alleles(outs) == 1) & has & ((k == 2) if one_derived else (k >= 2))
    return both.withColumn("ancestral", anc.cast("long")).withColumn("derived", F.when(ok, F.get(derived, F.lit(0))["base"])).withColumn("ancestral", F.when(ok, F.col("ancestral")))


def thin_kernel(positions, distance: int) -> list[int]:
    """Greedy thinning of sorted positions: the first is the anchor and is dropped.

    A later site stays if it lies ``distance`` or more beyond the last that stayed (at
    first: the anchor).
    """
    out, last = [], None
    for x in positions:
        if last is None:
            last = x
        elif x - last >= distance:
            out.append(x)
            last = x
    return out


def thin_sites(sites: DataFrame, distance: int) -> DataFrame:
    """Sites that ``thin_kernel`` keeps per scaffold; each step depends on the one before, so a scaffold's positions go to one task."""
    import pandas as pd

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = thin_kernel(sorted(set(pdf["position"])), distance)
        return pd.DataFrame({"scaffold": pdf["scaffold"].iloc[:1].repeat(len(kept)).to_numpy(), "position": kept}).astype({"position": "int64"})

    p = sites.select("scaffold", F.col("position").cast("long").alias("position"))
    return sites.join(p.groupBy("scaffold").applyInPandas(scan, "scaffold string, position long"), SITE, "left_semi")


def hwe_p(het: int, hom1: int, hom2: int) -> float | None:
    """Exact two-sided Hardy-Weinberg test: the chance of a het count as rare or rarer."""
    import math

    n = het + hom1 + hom2
    if n == 0:
        return None
    rare = 2 * min(hom1, hom2) + het
    other = 2 * n - rare
    logs = {}
    for h in range(rare % 2, rare + 1, 2):
        a, b = (rare - h) // 2, (other - h) // 2
        logs[h] = h * math.log(2) - sum(math.lgamma(x + 1) for x in (h, a, b))
    top = max(logs.values())
    p = {h: math.exp(x - top) for h, x in logs.items()}
    limit = p[het] * (1 + 1e-9)
    return min(1.0, sum(x for x in p.values() if x <= limit) / sum(p.values()))


def hwe_test(calls: DataFrame, *by: str) -> DataFrame:
    """Per biallelic site (and ``by``): het, hom1, hom2 (lower base first) and p."""
    import pandas as pd

    # genotypes as counts per site; the test itself runs once per distinct triple
    g = genotypes(calls).where("n_called = ploidy and ploidy = 2")
    low = F.array_min("alleles")
    g = g.groupBy(*SITE, *by).agg(
        F.count_if(F.col("n_distinct") == 2).alias("het"), F.min(low).alias("lo"), F.max(F.array_max("alleles")).alias("hi"),
        F.collect_list(F.when(F.col("n_distinct") == 1, low)).alias("homs"), F.array_size(F.array_distinct(F.flatten(F.collect_list("alleles")))).alias("k"),
    )
    g = g.where("k = 2").select(
        *SITE, *by, F.col("het").cast("long"), F.size(F.filter("homs", lambda x: x == F.col("lo"))).cast("long").alias("hom1"),
        F.size(F.filter("homs", lambda x: x == F.col("hi"))).cast("long").alias("hom2"),
    )

    def test(batches):
        for b in batches:
            yield b.assign(p=[hwe_p(*map(int, x)) for x in b[["het", "hom1", "hom2"]].itertuples(index=False)]).astype({"p": pd.Float64Dtype()})

    p = g.select("het", "hom1", "hom2").distinct().mapInPandas(test, "het long, hom1 long, hom2 long, p double")
    return g.join(p, ["het", "hom1", "hom2"])
