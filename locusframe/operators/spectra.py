"""Frequency tables, site frequency spectra and genotype patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.sites import COUNTS, SITE, n_alleles, ranked_alleles, site_counts


def frequency_table(calls: DataFrame, target: str | None = None, outgroup=None, as_counts: bool = False, min_data: float = 0.0, threshold: float | None = None, by: str = "pop", keep_empty: bool = True) -> DataFrame:
    """A row per site and population (or per sample, with ``by`` as "sample").

    Without a target ``value`` is "nA,nC,nG,nT"; with ``minor`` or ``derived`` it is the
    frequency (or count) of that allele over all populations' data; populations below
    ``min_data`` (a proportion) are null, as are sites where the allele is undefined. Unless
    ``keep_empty``, sites without any value (of counts: any but 0) are left out.
    """
    c = site_counts(calls, by)
    if target is None:
        return c.select(*SITE, by, F.concat_ws(",", *COUNTS).alias("value"))
    if target == "minor":
        from locusframe.operators.sites import minor_allele

        which = c.groupBy(*SITE).agg(*[F.sum(x).alias(x) for x in COUNTS]).select(*SITE, minor_allele().alias("_allele"))
    else:
        from locusframe.operators.sites import derived_allele

        which = derived_allele(c if by == "pop" else site_counts(calls, "pop"), outgroup).select(*SITE, F.col("derived").alias("_allele"))
    n = F.get(F.array(*COUNTS), F.col("_allele").cast("int"))
    enough = (F.col("called") > 0) & (F.col("called") >= min_data * F.col("haps"))
    value: Column = n if as_counts else F.try_divide(n.cast("double"), F.col("called").cast("double"))
    if threshold is not None:
        value = (value >= threshold).cast("int")
    out = c.join(which, SITE).select(*SITE, by, F.when(enough, value).alias("value"))
    if keep_empty:
        return out
    some = out.groupBy(*SITE).agg(F.max(F.col("value").cast("double")).alias("_top")).where(F.col("_top") > 0 if as_counts else F.col("_top").isNotNull())
    return out.join(some, SITE, "left_semi")


def target_counts(calls: DataFrame, pops: list, outgroup=None) -> DataFrame:
    """Per usable site the target allele's count in each population: n_0, n_1, ...

    Every population must be completely called and the site have one or two alleles.
    Polarised, the outgroup has one allele and the target is the other (invariant: 0);
    else the target is the second most frequent (equal counts: the lower base).
    """
    groups = [*pops, *([outgroup] if outgroup is not None else [])]
    cells = []
    for i, p in enumerate(groups):
        here = F.col("pop") == F.lit(p)
        cells += [F.count_if(here & (F.col("allele") == b)).alias(f"g{i}{c}") for b, c in enumerate(COUNTS)]
    s = calls.where(F.col("pop").isin(*groups)).groupBy(*SITE).agg(*cells, F.bool_and(F.col("allele").isNotNull()).alias("full")).where("full")
    total = lambda c, k: sum((F.col(f"g{i}{c}") for i in k), F.lit(0))
    everyone, inside = range(len(groups)), range(len(pops))
    s = s.where(n_alleles(F.array(*[total(c, everyone) for c in COUNTS])).between(1, 2))
    if outgroup is not None:
        o = len(pops)
        s = s.where(n_alleles(F.array(*[f"g{o}{c}" for c in COUNTS])) == 1)
        other = F.filter(F.array(*[F.when((total(c, inside) > 0) & (F.col(f"g{o}{c}") == 0), F.lit(b)) for b, c in enumerate(COUNTS)]), lambda x: x.isNotNull())
        s = s.withColumn("_t", F.get(other, F.lit(0)))
    else:
        s = s.withColumns({c: total(c, inside) for c in COUNTS})
        r = ranked_alleles()
        one, two = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        s = s.withColumn("_t", F.when(one["neg"] == two["neg"], F.least(one["base"], two["base"])).otherwise(two["base"]).cast("int"))
    return s.select(*SITE, *[F.coalesce(F.get(F.array(*[f"g{i}{c}" for c in COUNTS]), F.col("_t")), F.lit(0)).cast("long").alias(f"n_{i}") for i in inside])


def sfs(targets: DataFrame, dims: list[int], by: list[str] | None = None) -> DataFrame:
    """The spectrum over some of the populations (and ``by``, e.g. regions)."""
    return targets.groupBy(*(by or []), *[f"n_{d}" for d in dims]).agg(F.count("*").alias("sites"))


def all_spectra(targets: DataFrame, n_pops: int, size: int) -> DataFrame:
    """All spectra of ``size`` populations in one pass, as grouping sets; others are null."""
    from itertools import combinations

    cols = [f"n_{i}" for i in range(n_pops)]
    sets = [[F.col(cols[i]) for i in c] for c in combinations(range(n_pops), size)]
    return targets.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.count("*").alias("sites"))


def subsample_counts(calls: DataFrame, pops: list, n: int, seed: int = 42) -> DataFrame:
    """Target counts in ``n`` called haplotypes drawn per site and population.

    Haplotypes are drawn by hash of (seed, site, haplotype), so the draw does not depend
    on partitioning; sites where a population has fewer are left out.
    """
    c = calls.where(F.col("pop").isin(*pops) & F.col("allele").isNotNull())
    rank = F.struct(F.xxhash64(F.lit(seed), *SITE, "sample", "hap").alias("r"), F.col("allele").alias("allele"))
    s = c.groupBy(*SITE, "pop").agg(F.slice(F.array_sort(F.collect_list(rank)), 1, n).alias("x")).where(F.size("x") == n)
    got = s.select(*SITE, "pop", F.explode("x").alias("x")).select(*SITE, "pop", F.col("x.allele").alias("allele"))
    full = got.groupBy(*SITE).agg(F.count_distinct("pop").alias("k")).where(F.col("k") == len(pops)).drop("k")
    return target_counts(got.join(full, SITE), pops)


def subsample_individuals(calls: DataFrame, pops: list, n: int, seed: int = 42) -> DataFrame:
    """Target counts in ``n`` samples drawn per site and population, with all their calls.

    Samples without a call at the site are not drawn; draws go by hash of (seed, site, sample);
    sites where a population has fewer are left out.
    """
    c = calls.where(F.col("pop").isin(*pops) & F.col("allele").isNotNull())
    per = c.groupBy(*SITE, "pop", "sample").agg(F.collect_list("allele").alias("x"))
    rank = F.struct(F.xxhash64(F.lit(seed), *SITE, "sample").alias("r"), "sample", "x")
    s = per.groupBy(*SITE, "pop").agg(F.slice(F.array_sort(F.collect_list(rank)), 1, n).alias("v")).where(F.size("v") == n)
    got = s.select(*SITE, "pop", F.explode(F.flatten(F.transform("v", lambda v: v["x"]))).alias("allele"))
    full = got.groupBy(*SITE).agg(F.count_distinct("pop").alias("k")).where(F.col("k") == len(pops)).drop("k")
    return target_counts(got.join(full, SITE), pops)


def genotype_patterns(calls: DataFrame) -> DataFrame:
    """How often each pattern of genotypes over the samples occurs.

    A genotype is its alleles' frequency ranks (0 = most common, lower base first on
    ties) in ascending order; samples go in order; sites with missing calls are left out.
    """
    c = site_counts(calls).where("called = haps")
    rank = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.array_position(F.transform(ranked_alleles(), lambda x: x["base"]), b.cast("long")) - 1)
    g = calls.join(c.select(*SITE, rank.alias("_r")), SITE).withColumn("r", F.get("_r", F.col("allele").cast("int")))
    g = g.groupBy(*SITE, "sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x.cast("string")), "").alias("g"))
    p = g.groupBy(*SITE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "g"))), lambda x: x["g"]), " ").alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("sites"))
